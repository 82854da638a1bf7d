"""Secrets that no rule finds, and harmless texts like them.

Nothing here is trained on, but features and harmless values were chosen with the first forms in view.
"""

import base64
import random
import string

B62 = string.ascii_letters + string.digits


def _draw(rng, letters, n):
    return "".join(rng.choices(letters, k=n))


def _with_digits(rng, letters, n):
    value = _draw(rng, letters, n)
    return value if sum(c.isdigit() for c in value) > 1 else _with_digits(rng, letters, n)


def secrets(rng):
    """(kind, line, value)"""
    short = _with_digits(rng, B62, 12)
    yield "pwd", f"pwd = {short}", short
    bearer = _with_digits(rng, string.ascii_lowercase + string.digits, 32)
    yield "bearer", f"Authorization: Bearer {bearer}", bearer
    ghp = "ghp_" + _with_digits(rng, B62, 36)
    yield "prefixed", f"git clone with {ghp} from there", ghp
    aws = _with_digits(rng, B62, 40)
    yield "bare 40", f"the other one was {aws}", aws
    stripe = "sk_live_" + _with_digits(rng, B62, 24)
    yield "sk_live", f"stripe {stripe}", stripe
    upper = _with_digits(rng, string.ascii_uppercase + string.digits, 24)
    yield "capitals", f"license {upper}", upper
    encoded = base64.b64encode(rng.randbytes(33)).decode()
    yield "base64", f"CREDENTIAL={encoded}", encoded
    capital_hex = _draw(rng, "0123456789ABCDEF", 40)
    yield "capital hex", f"signing {capital_hex}", capital_hex
    spread = _with_digits(rng, B62, 20)
    yield "name apart", f"password is now {spread}", spread


def harmless(rng):
    n = rng.randint(0, 10**6)
    yield f"version {n % 9}.{n % 10}.{n % 13} of 2024-0{n % 9 + 1}-1{n % 9}"
    yield f"call +1 ({n % 900 + 100}) 555-{n % 10_000:04}"
    yield f"at {n % 255}.{n % 254}.{n % 253}.{n % 252}:8080"
    yield f"user{n % 100}.name@mail{n % 10}.example.org wrote"
    yield f"order {n * 7919} of {n % 99} items, total: {n % 10_000}.99"
    yield f"for i in range({n % 100}): x{n % 10} = y_{n % 10}[i] + {n % 7}"
    yield f"import sha256 from hashlib_v{n % 9}; utf8 = True"
    yield f"see https://example.org/2024/page{n % 100}?id={n}"
    yield f"ISO9001 and RTX4090 and B2B, the {n % 20}th, in Q{n % 4 + 1}"
    yield f"Donaudampfschifffahrtsgesellschaft and getElementById{n % 10}"
    yield f"the password is required; token: none; key = {n % 9}"


def other_secrets(rng):
    """Forms for which no feature or value was chosen; measured twice."""
    parts = [base64.urlsafe_b64encode(rng.randbytes(k)).decode().rstrip("=") for k in (27, 45, 32)]
    jwt = "eyJ" + ".".join(parts)
    yield "jwt", f"cookie session={jwt}; path", jwt
    google = "AIza" + _with_digits(rng, B62 + "_", 35)
    yield "google", f"maps?key={google}&v", google
    slack = f"xoxb-{rng.randrange(10**11, 10**12)}-{_with_digits(rng, B62, 24)}"
    yield "slack", f"slack says {slack}", slack
    link = _with_digits(rng, B62, 16)
    yield "in a link", f"postgres://app:{link}@db.example.org/main", link


def other_harmless(rng):
    n = rng.randint(0, 10**6)
    yield f"C6H12O6 and NaCl at {n % 90} K, H2SO4"
    yield f"v1.{n % 9}.3-14-g{n % 10}ab{n % 7}c of the branch"
    yield f"flight LH{n % 1000} to MUC, gate B{n % 60}, seat {n % 40}F"
    yield f"fe80::1ff:fe23:{n % 9000 + 1000}:890a is up"
    yield f"IMG_2024{n % 12:02}{n % 28:02}_{n % 10**6:06}.jpg was taken"
    yield f"chapter {n % 30}: Mp3Player and Win32Api, 3rd edition, 1990s"


def planted(n, seed=99, words=None, secrets=secrets, harmless=harmless):
    """(kind, text, (start, end)), and harmless texts, in surroundings of ``words``."""
    rng = random.Random(seed)
    words = words or ["".join(rng.choices("mnopqrst", k=rng.randint(2, 8))) for _ in range(300)]

    def around():
        return " ".join(rng.choices(words, k=15))

    found, clean = [], []
    for _ in range(n):
        for kind, line, value in secrets(rng):
            text = f"{around()} {line} {around()}"
            at = text.index(value)
            found.append((kind, text, (at, at + len(value))))
        clean += [f"{around()} {line} {around()}" for line in harmless(rng)]
    return found, clean


def measure(spans_of, n=40, words=None, **forms):
    """Recall per kind (a value counts if spans cover 90 % of it), and the false spans per harmless text."""
    found, clean = planted(n, words=words, **forms)
    hits = {}
    for kind, text, (a, b) in found:
        spans = spans_of(text)
        covered = sum(max(0, min(y, b) - max(x, a)) for x, y in spans)
        hits.setdefault(kind, []).append(covered >= 0.9 * (b - a))
    false = [text[a:b] for text in clean for a, b in spans_of(text)]
    return {k: sum(v) / len(v) for k, v in hits.items()}, false, len(clean)
