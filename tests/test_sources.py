import tracemalloc
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retail_lake.plans import medallion, registry
from retail_lake.sources import ranges, readers, sinks
from retail_lake.sources.fixture_spec import AS_OF
from retail_lake.sources.schemas import FORMATS, SCHEMAS
from tests.helpers import bag, dec, rows


def test_csv_with_accents_and_empty_fields(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("id,name,amount\n1,Éloïse 🛒,3.50\n2,,\n", encoding="utf-8")
    schema = T.StructType(
        [T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("amount", T.DecimalType(14, 2))]
    )
    assert rows(readers.read_csv(spark, str(path), schema)) == [
        {"id": 1, "name": "Éloïse 🛒", "amount": dec("3.50")},
        {"id": 2, "name": None, "amount": None},
    ]


def test_tsv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("id\ttext\n1\ta, b\n", encoding="utf-8")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
    assert rows(readers.read_tsv(spark, str(path), schema)) == [{"id": 1, "text": "a, b"}]


def test_json_array(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text('[{"store_id": 1,\n "store_name": "É"}, {"store_id": 2}]', encoding="utf-8")
    got = rows(readers.read_json_array(spark, str(path), SCHEMAS["store_locations"]).select("store_id", "store_name"))
    assert got == [{"store_id": 1, "store_name": "É"}, {"store_id": 2, "store_name": None}]


def test_json_fields(spark):
    df = spark.createDataFrame(
        [('{"a": {"b": [7, 8]}, "d": "2000-01-02", "n": "3.5"}',), ('{"a": 1}',), ("broken {",), (None,)], "v string"
    )
    out = readers.json_fields(
        df, "v", {"second": ("a.b[1]", "int"), "d": ("d", "date"), "n": ("n", "decimal(10,2)")}
    )
    got = [(r["second"], str(r["d"]) if r["d"] else None, r["n"]) for r in out.collect()]
    assert got == [(8, "2000-01-02", dec("3.50")), (None, None, None), (None, None, None), (None, None, None)]


def test_typed_and_rejects_split_the_rows(spark):
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("ok", T.BooleanType())])
    df = spark.createDataFrame([("1", "true"), ("x", "false"), ("2", "perhaps"), ("y", "no way"), (None, None)], "id string, ok string")
    assert rows(readers.typed(df, schema)) == [{"id": 1, "ok": True}, {"id": None, "ok": None}]
    assert {(r["id"], r["faults"]) for r in readers.rejects(df, schema).collect()} == {
        ("x", "id"), ("2", "ok"), ("y", "id,ok")
    }


def test_replace_table_partitioned_and_bucketed(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS sinks")
    df = spark.range(10).withColumn("p", F.col("id") % 2)
    sinks.create_or_replace_table(df, "sinks.t", partition_by=["p"])
    sinks.create_or_replace_table(df.filter("id < 4"), "sinks.t", bucket_by=(2, ["id"]))
    assert readers.scan(spark, "sinks.t").count() == 4
    assert readers.scan(spark, "spark_catalog.sinks.t").count() == 4


def test_export_and_load_counts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id int, t string")
    sinks.export_csv(df, str(tmp_path / "out"))
    assert bag(readers.read_csv(spark, str(tmp_path / "out"), df.schema)) == bag(df)
    assert len(list((tmp_path / "out").glob("*.csv"))) == 1
    counts = sinks.load_counts({"one": df, "none": df.filter("id > 5")})
    assert {(r["table_name"], r["row_count"]) for r in counts.collect()} == {("one", 2), ("none", 0)}


def test_buckets_save_the_shuffle(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS sinks")
    df = spark.range(100).withColumn("k", F.col("id") % 10)
    sinks.create_or_replace_table(df, "sinks.b", bucket_by=(4, ["k"]))
    plan = readers.scan(spark, "sinks.b").groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.fixture(scope="module")
def raw_files(lake, tmp_path_factory):
    """The bronze fixtures written in the formats raw files come in."""
    root = tmp_path_factory.mktemp("raw")
    paths = {}
    for table, schema in SCHEMAS.items():
        df = lake.bronze(table).select(*schema.names)
        path = str(root / table)
        kind = FORMATS.get(table, "csv")
        if kind == "json":
            objects = ",\n".join(r["value"] for r in df.select(F.to_json(F.struct("*")).alias("value")).collect())
            (root / table).mkdir()
            (root / table / "part.json").write_text(f"[{objects}]", encoding="utf-8")
        else:
            separator = "\t" if kind == "tsv" else ","
            writer = df.write.option("header", True).option("sep", separator)
            writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
        paths[table] = path
    return paths


def test_layers_end_to_end(spark, lake, raw_files):
    counts = medallion.ingest(spark, raw_files, "t_bronze")
    got = {r["table_name"]: r["row_count"] for r in counts.collect()}
    assert {t: got[t] for t in SCHEMAS} == {t: lake.bronze(t).count() for t in SCHEMAS}
    assert {n for t, n in got.items() if t.endswith("_rejects")} == {0}
    medallion.clean(spark, AS_OF, "t_bronze", "t_silver", buckets=4)
    from retail_lake.plans.silver import CLEANERS

    for table in ("financial_transactions", "inventory", "product_reviews", "employee_records"):
        stored = readers.scan(spark, f"t_silver.{table}_clean")
        direct = CLEANERS[table](lake.bronze(table).select(*SCHEMAS[table].names), AS_OF)
        assert bag(stored) == bag(direct), table
    medallion.build_gold(spark, AS_OF, "t_silver", "t_gold")
    sizes = {r["table_name"]: r["row_count"] for r in medallion.build_features(spark, "t_gold").collect()}
    assert set(sizes) == set(medallion.FEATURES)
    assert sizes["features_clients"] == readers.scan(spark, "t_gold.customer_rfm").count() == 150
    wide = readers.scan(spark, "t_gold.sales_full_enriched")
    assert wide.select("transaction_id").distinct().count() == 1500
    # the pre-aggregated daily sales hold exactly the rows of the row-level table
    rows_per_day = readers.scan(spark, "t_gold.ventes_enrichies").groupBy(
        "transaction_date", "region", "categorie_promo"
    ).agg(F.count("*").alias("nb_ventes_jour"))
    daily = readers.scan(spark, "t_gold.ventes_par_jour").select(*rows_per_day.columns)
    assert bag(daily) == bag(rows_per_day)


PAIR = T.StructType([T.StructField("id", T.LongType()), T.StructField("amount", T.DecimalType(8, 2))])


def _file(tmp_path, text):
    path = tmp_path / "file.csv"
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_delimited_columns_go_by_name(spark, tmp_path):
    path = _file(tmp_path, "Amount,currency,id\n3.50,EUR,7\n")
    assert [tuple(r) for r in readers.read_csv(spark, path, PAIR).collect()] == [(7, Decimal("3.50"), "EUR")]


def test_delimited_file_without_a_column_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="amount"):
        readers.read_csv(spark, _file(tmp_path, "id,price\n1,2\n"), PAIR)


def test_delimited_quotes_and_line_breaks(spark, tmp_path):
    path = _file(tmp_path, 'id,amount,note\n1,2,"a ""b"", c"\n2,3,"x\ny"\n')
    got = readers.read_csv(spark, path, PAIR, multi_line=True).orderBy("id").collect()
    assert [r["note"] for r in got] == ['a "b", c', "x\ny"]


def test_what_does_not_fit_is_kept_with_a_reason(spark, tmp_path):
    raw = readers.read_delimited(spark, _file(tmp_path, "id,amount\n7,abc\n8,1,2\n9\n1,2\n,\n"), PAIR)
    bad = {r["id"]: r["faults"] for r in readers.rejects(raw, PAIR).collect()}
    assert bad == {"7": "amount", "8": "line", "9": "line"}
    assert {r["id"] for r in readers.typed(raw, PAIR).collect()} == {1, None}


def test_json_array_by_lines(spark, tmp_path):
    path = _file(tmp_path, '[{"id": 1, "amount": 2.5},\n{"id": 2, "amount": null}]\n')
    got = readers.read_json_lines_array(spark, path, PAIR).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, Decimal("2.50")), (2, None)]


def test_buckets_do_not_multiply_files(spark):
    sinks.create_or_replace_table(spark.range(0, 10_000, 1, 16), "t_buckets", bucket_by=(8, ["id"]))
    assert len(spark.table("t_buckets").inputFiles()) <= 8


def test_scope_and_release_remove_what_was_frozen(spark):
    from pathlib import Path

    from retail_lake import session

    def files():
        root = Path(session.scratch_dir(spark).removeprefix("file:"))
        return [p for p in root.rglob("*.parquet")] if root.exists() else []

    before = len(files())
    with session.scope(spark):
        assert session.freeze(spark.range(3)).count() == 3
    assert len(files()) == before
    session.freeze(spark.range(3))
    session.release(spark)
    assert files() == []


ELEMENTS = [
    '{"id": 1, "note": "a, b"}', '{"id":"x"}', '{"id": 2, "note": "brackets ]}[{ and \\"quotes\\" \\\\"}', "7", "null", '"text, too"',
    "[1, 2]", '{"id": 3, "note": {"deep": [1, {"er": 2}]}}', '{"note": null}', '{"id": 4.5}', '{"id": 5, "note": "é\\n\\\\\\\\"}', "{}",
]
NOTES = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("note", T.StringType())])


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_json_arrays_are_cut_into_elements_at_any_range(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(ranges, "AHEAD", max(size, 5))
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a b%.json").write_text(" [\n" + " ,\n ".join(ELEMENTS) + "\n]\n", encoding="utf-8")
    (tmp_path / "j" / "none.json").write_text("[]")
    (tmp_path / "j" / "cut.json").write_text('[{"id": 8}, {"id": 9, "note": "no e')
    got = [r.value for r in ranges.json_elements(spark, str(tmp_path / "j"), size).collect()]
    assert sorted(got) == sorted([*ELEMENTS, '{"id": 8}', '{"id": 9, "note": "no e'])
    raw = readers.json_text(spark, str(tmp_path / "j"), NOTES, range_size=size)
    assert {(r.id, r.note) for r in readers.typed(raw, NOTES).collect()} == {
        (1, "a, b"), (2, 'brackets ]}[{ and "quotes" \\'), (3, '{"deep":[1,{"er":2}]}'), (None, None), (5, "é\n\\\\"), (8, None)
    }
    bad = {(r.id, r[readers.BROKEN], r.faults) for r in readers.rejects(raw, NOTES).collect()}
    assert bad == {
        ("x", None, "id"), ("4.5", None, "id"), (None, "7", "line"), (None, "null", "line"), (None, '"text, too"', "line"),
        (None, "[1, 2]", "line"), (None, '{"id": 9, "note": "no e', "line"),
    }


def test_what_follows_a_fault_of_structure_is_refused_not_lost(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"id": 1}}, {"id": 2}, {"id": 3}] tail')
    raw = readers.json_text(spark, str(tmp_path / "x.json"), NOTES)
    seen = " ".join(str(tuple(r)) for r in raw.collect())
    assert all(part in seen for part in ("1", "2", "3", "tail"))


@pytest.mark.parametrize("size", [1, 9, 50, 1 << 20])
def test_quoted_line_breaks_at_any_range(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(ranges, "AHEAD", max(size, 4))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "1.csv").write_text('id,text\n1,"a\nb ""q"", \r\n c"\n2,plain\n3,"x"\n4\n5,,6\n\n6,"end\n"', newline="")
    (tmp_path / "c" / "2.csv").write_text('\ufeffid,text\r\n7,"\n\n"\r\n8,\r\n', encoding="utf-8", newline="")
    (tmp_path / "c" / "3.csv").write_text("id,text")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
    raw = readers.read_delimited(spark, str(tmp_path / "c"), schema, multi_line=True, range_size=size)
    assert sorted((r.id, r.text) for r in readers.typed(raw, schema).collect()) == [
        (1, 'a\nb "q", \r\n c'), (2, "plain"), (3, "x"), (6, "end\n"), (7, "\n\n"), (8, None)
    ]
    assert sorted(r[readers.BROKEN] for r in readers.rejects(raw, schema).collect()) == ["4", "5,,6"]


def test_one_file_of_quoted_line_breaks_is_many_tasks(spark, tmp_path):
    (tmp_path / "big.csv").write_text("id,text\n" + "".join(f'{i},"a\n{i}"\n' for i in range(3_000)))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
    raw = readers.read_delimited(spark, str(tmp_path / "big.csv"), schema, multi_line=True, range_size=2_000)
    assert raw.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert [r.text for r in raw.orderBy(F.col("id").cast("int")).collect()] == [f"a\n{i}" for i in range(3_000)]


def test_a_failed_write_leaves_the_old_table(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS sinks")
    sinks.create_or_replace_table(spark.range(3), "sinks.safe")
    fails = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        sinks.create_or_replace_table(fails, "sinks.safe")
    assert sorted(r.id for r in spark.table("sinks.safe").collect()) == [0, 1, 2]
    sinks.create_or_replace_table(spark.table("sinks.safe").selectExpr("id + 1 as id"), "sinks.safe", bucket_by=(2, ["id"]))
    assert sorted(r.id for r in spark.table("sinks.safe").collect()) == [1, 2, 3]
    assert [t.name for t in spark.catalog.listTables("sinks") if t.name.startswith("safe")] == ["safe"]


def test_refused_rows_are_what_the_cleaner_drops(lake):
    from retail_lake.plans import silver

    for table, (keys, _) in silver.LATEST.items():
        df = lake.bronze(table)
        kept, gone = silver.CLEANERS[table](df, AS_OF), silver.refused(table, df, AS_OF)
        names = [F.trim(k).alias(k) if k == "warehouse" else F.col(k) for k in keys]
        assert bag(kept.select(*names).unionByName(gone.select(*names))) == bag(df.select(*names).distinct())
        assert gone.filter("refused_by = ''").count() == 0


@pytest.mark.parametrize("json", [False, True])
def test_a_range_is_gone_through_in_blocks(tmp_path, json):
    """Working memory is that of a block, not of a range: before, 24 MB took some forty times the range."""
    path = tmp_path / "big"
    record = '{"id": 1, "note": "a, b"}' if json else '1,"a\nb"'
    n = (24 << 20) // (len(record) + 1)
    path.write_text(f"[{','.join([record] * n)}]" if json else f"{record}\n" * n)
    row = {"path": str(path), "length": path.stat().st_size, "start": 0, "quoted": False, "escaped": False, "depth": 0}
    tracemalloc.start()
    with ranges._opened(f"file:{path}") as file:
        odd, change = ranges._change(file, 0, ranges.RANGE, json, False, ranges.AHEAD)
        found = sum(bool(r.strip()) for r in ranges._begun(file, row, ranges.RANGE, json, ranges.AHEAD))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (odd, change[0], found) == (False, 0, n)
    assert peak < 64 << 20


def test_array_files_are_written_in_lines_of_a_batch(spark, tmp_path):
    """No row holds all objects of a task."""
    objects = spark.range(0, 50_000, 1, 2).selectExpr("""concat('{"id": ', id, '}') as value""")
    objects.mapInArrow(registry._in_arrays, "value string").write.text(str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).agg(F.max(F.length("value"))).first()[0] < 50_000 * 5
    assert sorted(r.id for r in readers.read_json_array(spark, str(tmp_path / "j"), NOTES).collect()) == list(range(50_000))
