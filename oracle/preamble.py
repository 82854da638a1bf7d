"""Input rows as common table expressions, and small SQL text helpers."""

from __future__ import annotations

import re

from retail_lake.functions.bands import Bands
from retail_lake.sources.fixture_spec import AS_OF, BRONZE, RAW_TEXT_COLUMNS, SILVER

TODAY = f"date '{AS_OF}'"

SHORT = {
    "tx": "financial_transactions",
    "cust0": "customer_demographics",
    "promo": "promotions",
    "camp": "marketing_campaigns",
    "rev": "product_reviews",
    "inv": "inventory",
    "ship": "logistics_and_shipping",
    "supp": "supplier_information",
    "serv": "customer_service_interactions",
    "emp": "employee_records",
    "store": "store_locations",
}


def _silver(name: str) -> str:
    spec = SILVER[SHORT[name]]
    columns = ", ".join(f"{e} as {c}" for c, e in spec.columns.items())
    source = spec.base
    if spec.slots > 1:
        numbers = ", ".join(f"({i})" for i in range(spec.slots))
        source += f" cross join (values {numbers}) as slots(slot)"
    for table, left, key in spec.lookups:
        source += f" left join {table} on {left} = {key}"
    return f"{name} as (select {columns} from {source})"


def _bronze(name: str) -> str:
    table = SHORT[name]
    faults = BRONZE[table]
    names = [*SILVER[table].columns, *(c for c in faults if c not in SILVER[table].columns)]
    columns = ", ".join(f"{faults.get(c, c)} as {c}" for c in names)
    return f"b_{name} as (select {columns} from {name} cross join (values (0), (1)) as v(slot))"


def bronze_columns(name: str) -> list[str]:
    table = SHORT[name]
    return [*SILVER[table].columns, *(c for c in BRONZE[table] if c not in SILVER[table].columns)]


def case_of(bands: Bands, value: str) -> str:
    signs = {"below": "<", "upto": "<=", "atleast": ">="}
    out = "case"
    for b in bands.bands:
        if b.test == "within":
            out += f" when {value} >= {b.bounds[0]} and {value} <= {b.bounds[1]} then '{b.label}'"
        else:
            out += f" when {value} {signs[b.test]} {b.bounds[0]} then '{b.label}'"
    return f"{out} else '{bands.otherwise}' end"


def r(value: str, digits: int = 2) -> str:
    """Round half up, as a double."""
    return f"cast(round(cast({value} as decimal(38,8)), {digits}) as double)"


def d(value: str) -> str:
    return f"cast({value} as double)"


def quot(num: str, den: str) -> str:
    return f"({d(num)} / nullif({d(den)}, 0))"


def mean(value: str, digits: int | None = 2) -> str:
    return mean_of(f"sum({value})", f"count({value})", digits)


def mean_of(total: str, n: str, digits: int | None = 2) -> str:
    """Sum over count in whole numbers, half up: floor of the mean in result digits plus a half."""
    if digits is None:
        return quot(total, n)
    micro = f"cast(cast({total} as decimal(38,6)) * 1000000 as hugeint)"
    unit = f"nullif(cast({n} as hugeint) * {10 ** (6 - digits)}, 0)"
    return f"(sign({micro}) * cast((2 * abs({micro}) + {unit}) // (2 * {unit}) as double) / {10 ** digits})"


def pct(num: str, den: str, digits: int = 2) -> str:
    return r(f"{d(num)} * 100.0 / nullif({d(den)}, 0)", digits)


def share(condition: str, digits: int = 2) -> str:
    return pct(f"count(*) filter (where {condition})", "count(*)", digits)


def total(value: str) -> str:
    return r(f"sum({value})")


def big(value: str) -> str:
    return f"cast({value} as bigint)"


def small(value: str) -> str:
    return f"cast({value} as integer)"


def month(value: str) -> str:
    return f"cast(date_trunc('month', {value}) as date)"


def quarter(value: str) -> str:
    return f"cast(date_trunc('quarter', {value}) as date)"


def days(start: str, end: str) -> str:
    return small(f"date_diff('day', {start}, {end})")


def season(day: str) -> str:
    return (
        f"case month({day}) // 3 % 4 when 0 then 'Hiver' when 1 then 'Printemps' when 2 then 'Été' "
        "else 'Automne' end"
    )


def _derived() -> dict[str, str]:
    from oracle import derived

    return derived.tables()


def with_inputs(body: str) -> str:
    """Put the tables a query names, and those they need, in front of it."""
    from retail_lake.functions import labels

    known = {name: _silver(name) for name in SHORT}
    known |= {f"b_{name}": _bronze(name) for name in SHORT}
    known["cust"] = (
        f"cust as (select *, {case_of(labels.AGE_GROUP, 'age')} as age_group from (select *, "
        f"{small(f'year({TODAY}) - year(date_of_birth)')} as age from cust0))"
    )
    known["raw_text"] = (
        "raw_text as (select " + ", ".join(f"{e} as {c}" for c, e in RAW_TEXT_COLUMNS.items()) + " from tx)"
    )
    known |= {name: f"{name} as ({sql})" for name, sql in _derived().items()}
    used: list[str] = []

    def visit(text: str, own: str = "") -> None:
        for name in known:
            if name != own and name not in used and re.search(rf"\b(?:from|join)\s+{name}\b", text):
                visit(known[name], name)
                if name not in used:
                    used.append(name)

    visit(body)
    if not used:
        return body
    head = ",\n".join(known[n] for n in used)
    if body.lstrip().startswith("with "):
        return f"with {head},\n{body.lstrip()[5:]}"
    return f"with {head}\n{body}"
