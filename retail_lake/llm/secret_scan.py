"""Secrets in texts: three fixed rules and a linear-chain conditional random field.

The field tags tokens as beginning, inside or outside of a secret value, from the shape of the
token and its neighbours, the neighbouring words and a few facts about the file; Viterbi decodes
it. It is trained on parts that hold what the rules find, drawn from all texts, on parts of at
most SAMPLE texts that hold nothing, and on rewritten surroundings of what the rules find: another
value, in a form of its own, with the naming word and the separator changed or left out, or a
harmless value in its place. So the form of a value and what stands around it must tell, and the
field adds spans that the rules miss, such as a key after another word or after none.

Nearly all tokens are plain words among plain words. If the trained weights prove that such a
token is outside whatever its neighbours are, only the stretches around other tokens are decoded,
with the same result as decoding the whole text; else whole texts are decoded.
"""

from __future__ import annotations

import logging
import random
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_lake.llm.memory import lean

#: Texts the field is trained on, stretches taken from them, and rounds of training.
SAMPLE, STRETCHES, ROUNDS = 20_000, 6_000, 60
#: Rewritten surroundings made of one value at most.
REWRITES = 40
#: Tokens of a part of a stretch that is learned from.
PART = 200
#: Tokens, with what fills short parts up, that the training looks at together: 9 MB of emissions.
TOGETHER = 1 << 15
KINDS = ("assign", "access", "hex", "crf")

# fixed values: the base rules
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

TOKEN = re.compile(r"\w+|[^\w\s]")
#: Tokens that are not plain: with a digit, very long, naming a secret, or marks of assignment.
TELLING = re.compile(r"(?i)\b[^\W\d]*\d\w*|\b\w{20,}|\b(?:pass\w*|secret\w*|token\w*|api_?key\w*|key|auth\w*|credential\w*)\b|[=:\"]")
_NAMING = re.compile(r"(?ai)pass\w*|secret\w*|token\w*|api_?key\w*|key|auth\w*|credential\w*")
_WORDY = re.compile(r"\w")
REACH = 3
_HINTS = ("pass", "secret", "token", "api")

SHAPES = 64
#: Changes between digits, small and capital letters; a capital before small letters begins a word.
_CHANGE = re.compile(r"(?<=[a-z])(?:[0-9]|[A-Z](?![a-z]))|(?<=[A-Z])[0-9]|(?<=[0-9])[A-Za-z]")
MANY_CHANGES = 4
_MARKS = "=:\"'@.-+/()"
_PLAIN_MARKS = [1, *(2 + i for i, c in enumerate(_MARKS) if c not in "=:\"")]
_PLAIN = [0, *_PLAIN_MARKS]
WORD_BITS = 9
_OFFSETS = range(-REACH, REACH + 1)
_WORDS_AT = (-2, -1, 1)
#: Facts about the file; then whether a token touches its neighbours, for plain tokens and for others.
_FACTS, _TOUCH = 16, 4
N_FEATURES = len(_OFFSETS) * SHAPES + len(_WORDS_AT) * (1 << WORD_BITS) + _FACTS + 2 * _TOUCH
WIDTH = len(_OFFSETS) + len(_WORDS_AT) + 2
OUT, BEGIN, INSIDE = 0, 1, 2
_HALF = 1 << (WORD_BITS - 1)
#: So much a word that names no secret may speak for one standing near it.
WORD_SAYS = 0.3
#: So much a plain token near it or a fact about the file may; and a plain token is at least so
#: much surer of being outside.
SAYS, PLAIN_LEAD = 0.1, 4.0
#: Penalty on the squared weights of words, so that forms and marks carry more than single words.
WORD_DECAY = 3e-3


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the rules find, in order; leftmost, not overlapping, per kind."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LEAST:
                found.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def values(text: str) -> list[tuple[int, int]]:
    """Where the secret values of the rules lie: what the field learns to find."""
    found = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    return found + [m.span() for m in HEX.finditer(text)]


def shape(token: str) -> int:
    """A number below SHAPES - 1; 0 is a plain word."""
    if not token[0].isalnum() and token[0] != "_":
        return 2 + _MARKS.find(token[0])  # 1 to 12
    if _NAMING.fullmatch(token):
        return 13
    digits = sum(c.isdigit() for c in token)
    size = 0 if len(token) < 8 else 1 if len(token) < 16 else 2 if len(token) < 24 else 3
    if digits == 0:
        return 14 + size if len(token) >= 20 else 0
    if digits == len(token):
        return 18 + size
    if all(c in "0123456789abcdef" for c in token):
        return 22 + size
    if token.isupper():
        return 26 + size + (4 if token.startswith("AKIA") else 0)
    many = 8 if len(_CHANGE.findall(token)) >= MANY_CHANGES else 0
    return many + (34 + size if token.islower() else 38 + size)


def _word(token: str) -> int:
    """A number for the word; those that name secrets have the upper half."""
    return (zlib.crc32(token.lower().encode()) & (_HALF - 1)) + (_HALF if _NAMING.fullmatch(token) else 0)


def _features(text: str, spans: list[tuple[int, int]], file: int) -> np.ndarray:
    """Feature numbers per token: shapes and words around it, facts about the file, what it touches."""
    n = len(spans)
    tokens = [text[a:b] for a, b in spans]
    shapes = [SHAPES - 1] * REACH + [shape(t) for t in tokens] + [SHAPES - 1] * REACH
    words = [0] * REACH + [_word(t) for t in tokens] + [0] * REACH
    out = np.empty((n, WIDTH), dtype=np.int32)
    at = 0
    for j, step in enumerate(_OFFSETS):
        out[:, j] = at + np.array(shapes[REACH + step : REACH + step + n])
        at += SHAPES
    for j, step in enumerate(_WORDS_AT):
        out[:, len(_OFFSETS) + j] = at + np.array(words[REACH + step : REACH + step + n])
        at += 1 << WORD_BITS
    out[:, -2] = at + file
    starts, ends = np.array(spans).T
    touch = np.zeros(n, dtype=np.int32)
    touch[1:] = starts[1:] == ends[:-1]
    touch[:-1] += 2 * (starts[1:] == ends[:-1])
    own = np.array(shapes[REACH : REACH + n])
    out[:, -1] = at + _FACTS + touch + _TOUCH * ~np.isin(own, _PLAIN)
    return out


def _file(text: str) -> int:
    """Facts about the file, below 16: is it code-like, does it name secrets, hold addresses, is it long."""
    low = text.lower()
    code = text.count("=") + text.count(";") + text.count("{") > max(3, len(text) // 200)
    return code + 2 * any(h in low for h in _HINTS) + 4 * ("@" in text) + 8 * (len(text) > 20_000)


def stretches(text: str, whole: bool = False) -> Iterator[tuple[list[tuple[int, int]], np.ndarray]]:
    """Token spans and features of the parts to decode, or of the whole text."""
    telling = [m.span() for m in TELLING.finditer(text)]
    if not telling and not whole:
        return
    file = _file(text)
    if whole:
        spans = [m.span() for m in TOKEN.finditer(text)]
        if spans:
            yield spans, _features(text, spans, file)
        return
    # parts of the text around telling tokens, wide enough for their neighbours' neighbours
    parts: list[list[int]] = []
    for a, b in telling:
        low, high = _back(text, a), _ahead(text, b)
        if parts and low <= parts[-1][1]:
            parts[-1][1] = max(parts[-1][1], high)
        else:
            parts.append([low, high])
    for low, high in parts:
        spans = [m.span() for m in TOKEN.finditer(text, low, high)]
        yield spans, _features(text, spans, file)


def _back(text: str, at: int) -> int:
    """Where the 2 * REACH tokens before ``at`` begin, taken generously."""
    width = 64
    while True:
        low = max(0, at - width)
        while low and (text[low - 1].isalnum() or text[low - 1] == "_"):
            low -= 1
        found = [m.start() for m in TOKEN.finditer(text, low, at)]
        if low == 0 or len(found) >= 2 * REACH:
            return found[-2 * REACH] if len(found) >= 2 * REACH else low
        width *= 4


def _ahead(text: str, at: int) -> int:
    end = at
    for k, m in enumerate(TOKEN.finditer(text, at)):
        end = m.end()
        if k == 2 * REACH - 1:
            break
    return end


@dataclass
class Field:
    """Weights of the features for each tag, and of the transitions between tags."""

    weights: np.ndarray
    moves: np.ndarray
    whole: bool = False  # whether plain tokens must be decoded too

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The best tags; what stands before and after is outside."""
        emit = self.weights[features].sum(axis=1)
        best = emit[0] + self.moves[OUT]
        back = np.zeros((len(emit), 3), dtype=np.int64)
        for i in range(1, len(emit)):
            ways = best[:, None] + self.moves
            back[i] = ways.argmax(axis=0)
            best = ways.max(axis=0) + emit[i]
        tags = np.zeros(len(emit), dtype=np.int64)
        tags[-1] = int((best + self.moves[:, OUT]).argmax())
        for i in range(len(emit) - 1, 0, -1):
            tags[i - 1] = back[i, tags[i]]
        return tags


def _blocks(examples: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features, tags and which of them are real, of parts of about equal length; shorter ones are filled up.

    A block has at most TOGETHER tokens, or one part.
    """
    examples = sorted(examples, key=lambda e: len(e[1]))
    out, at = [], 0
    while at < len(examples):
        end = at + 1
        while end < len(examples) and (end + 1 - at) * len(examples[end][1]) <= TOGETHER:
            end += 1
        size = (end - at, len(examples[end - 1][1]))
        x = np.full((*size, examples[at][0].shape[1]), N_FEATURES, dtype=np.min_scalar_type(N_FEATURES))
        y = np.zeros(size, dtype=np.int8)
        real = np.zeros(size, dtype=bool)
        for i, (features, tags) in enumerate(examples[at:end]):
            x[i, : len(tags)], y[i, : len(tags)], real[i, : len(tags)] = features, tags, True
        out.append((x, y, real))
        at = end
    return out


def _gradients(weights: np.ndarray, moves: np.ndarray, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the negative log-likelihood of a block, by weights and by transitions."""
    length, width = x.shape[1:]
    emit = weights[x].sum(axis=2)
    alpha = np.empty_like(emit)
    beta = np.zeros_like(emit)
    alpha[:, 0] = emit[:, 0] + moves[OUT]
    for t in range(1, length):
        new = np.logaddexp.reduce(alpha[:, t - 1, :, None] + moves, axis=1) + emit[:, t]
        alpha[:, t] = np.where(real[:, t, None], new, alpha[:, t - 1])
    beta[:, -1] = moves[:, OUT]
    for t in range(length - 2, -1, -1):
        new = np.logaddexp.reduce(moves + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
        beta[:, t] = np.where(real[:, t + 1, None], new, moves[:, OUT])
    log_z = np.logaddexp.reduce(alpha[:, -1] + moves[:, OUT], axis=1)
    prob = np.exp(alpha + beta - log_z[:, None, None])
    truth = np.eye(3)[y]
    diff = (prob - truth)[real]
    flat = x[real].ravel()
    g_weights = np.stack([np.bincount(flat, np.repeat(diff[:, tag], width), N_FEATURES + 1) for tag in range(3)], axis=1)
    g_moves = np.zeros((3, 3))
    for t in range(1, length):
        pair = np.exp(alpha[:, t - 1, :, None] + moves + (emit[:, t] + beta[:, t])[:, None, :] - log_z[:, None, None])
        g_moves += pair[real[:, t]].sum(axis=0)
        np.add.at(g_moves, (y[real[:, t], t - 1], y[real[:, t], t]), -1)
    last = real.sum(axis=1) - 1
    g_moves[:, OUT] += (prob - truth)[np.arange(len(y)), last].sum(axis=0)
    g_moves[OUT] += (prob - truth)[:, 0].sum(axis=0)
    return g_weights, g_moves


def train(examples: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS, bounded: bool = True) -> Field | None:
    """Maximum likelihood by Adam, all stretches in every round; None if no example has a secret.

    The gradient is added up over blocks, so that the driver holds the emissions of one block only.
    ``bounded`` keeps the weights where plain tokens are provably outside, so that they can be skipped.
    """
    examples = [(x[:200], y[:200]) for x, y in examples if len(y)]  # one stretch cut is one example
    if not any(y.any() for _, y in examples):
        return None
    blocks = _blocks(examples)
    weights, moves = np.zeros((N_FEATURES + 1, 3)), np.zeros((3, 3))
    own = REACH * SHAPES
    weights[own : own + SHAPES, OUT] = 2.0  # what is never seen stays outside
    state = [np.zeros_like(p) for p in (weights, moves, weights, moves)]
    decay = np.full((N_FEATURES + 1, 1), 1e-4)
    first_word = len(_OFFSETS) * SHAPES
    decay[first_word : first_word + (len(_WORDS_AT) << WORD_BITS)] = WORD_DECAY
    seen = np.zeros((N_FEATURES + 1, 1), dtype=bool)
    for x, _, real in blocks:
        seen[x[real].ravel()] = True
    for step in range(1, rounds + 1):
        g_weights, g_moves = np.zeros_like(weights), np.zeros_like(moves)
        for block in blocks:
            of_weights, of_moves = _gradients(weights, moves, *block)
            g_weights += of_weights
            g_moves += of_moves
        grads = (g_weights / len(examples) + decay * weights * seen, g_moves / len(examples) + 1e-4 * moves)
        for p, g, m, v in zip((weights, moves), grads, state[:2], state[2:], strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights[N_FEATURES] = 0
        for held, most in _bounds(moves) if bounded else ():
            weights[held, 1:] = np.minimum(weights[held, 1:], weights[held, :1] + most)
    field = Field(weights[:N_FEATURES], moves)
    field.whole = not _plain_is_outside(field)
    return field


def _gain(m: np.ndarray) -> float:
    """The most that the two transitions next to a token can gain if it is not outside."""
    return max(m[a, x] + m[x, b] - m[a, OUT] - m[OUT, b] for a in range(3) for b in range(3) for x in (BEGIN, INSIDE))


def _bounds(moves: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """Features of plain tokens, and how much they may speak for begin or inside over outside.

    The token's own shape outweighs all else that may speak for it and its transitions.
    """
    plain = np.array(_PLAIN)
    others = SAYS * (len(_OFFSETS) - 1 + 2) + WORD_SAYS * len(_WORDS_AT)
    lead = max(PLAIN_LEAD, _gain(moves) + others + 0.1)
    out = []
    at = 0
    for step in _OFFSETS:
        out.append((at + (np.append(plain, SHAPES - 1) if step else plain), SAYS if step else -lead))
        at += SHAPES
    for _ in _WORDS_AT:
        out.append((np.arange(at, at + _HALF), WORD_SAYS))
        at += 2 * _HALF
    return [*out, (np.arange(at, at + _FACTS + _TOUCH), SAYS)]


def _plain_is_outside(field: Field) -> bool:
    """Whether a plain token among plain ones is outside in every best path.

    Its features are known but for its neighbours' words and the file, so the most favourable of
    these is taken, and the most that the two transitions next to it can gain.
    """
    w = field.weights
    lead = w[:, OUT : OUT + 1] - w[:, 1:]  # of outside over the two others
    margin = np.zeros(2)
    at = 0
    for step in _OFFSETS:
        # the token itself is a word or a mark; around it words, marks or the edge of the text
        margin += lead[[at, *(at + k for k in _PLAIN_MARKS), *([at + SHAPES - 1] if step else [])]].min(axis=0)
        at += SHAPES
    for _ in _WORDS_AT:
        margin += lead[at : at + _HALF].min(axis=0)
        at += 1 << WORD_BITS
    margin += lead[at : at + _FACTS].min(axis=0) + lead[at + _FACTS : at + _FACTS + _TOUCH].min(axis=0)
    return bool((margin > _gain(field.moves)).all())


def field_spans(text: str, field: Field) -> list[tuple[int, int]]:
    """Spans of the runs that begin with a begin tag (or an inside tag after outside)."""
    found: list[tuple[int, int]] = []
    for spans, features in stretches(text, field.whole):
        tags = field.decode(features)
        open_ = False
        for (a, b), tag in zip(spans, tags.tolist(), strict=True):
            if tag == OUT:
                open_ = False
            elif tag == INSIDE and open_:
                found[-1] = (found[-1][0], b)
            else:
                found.append((a, b))
                open_ = True
    return found


def all_spans(text: str, field: Field | None) -> list[tuple[int, int, int]]:
    """The spans of the rules, and what the field finds beside them: the parts that no rule covers."""
    base = base_spans(text)
    if field is None:
        return base
    more = []
    for a, b in field_spans(text, field):
        at = a
        for x, _, y in base:  # in order of their starts
            if x >= b:
                break
            if x > at:
                more.append((at, 3, x))
            at = max(at, y)
        if at < b:
            more.append((at, 3, b))
    return sorted(base + [m for m in more if _WORDY.search(text, m[0], m[2])])


def parts_of(tags: np.ndarray, most: int = PART) -> list[tuple[int, int]]:
    """Cuts a stretch into parts of at most ``most`` tokens, and never within a labelled value.

    Only a value that is longer itself is cut off.
    """
    out, at = [], 0
    while at < len(tags):
        end = stop = min(at + most, len(tags))
        while end > at and end < len(tags) and tags[end] == INSIDE:
            end -= 1
        if end == at:  # a value longer than a part
            end, after = stop, stop
            while after < len(tags) and tags[after] == INSIDE:
                after += 1
            out.append((at, end))
            at = after
            continue
        out.append((at, end))
        at = end
    return out


def _tags(spans: list[tuple[int, int]], known: list[tuple[int, int]]) -> np.ndarray:
    """The tag of each token, given where the values lie."""
    tags = np.zeros(len(spans), dtype=np.int8)
    starts, ends = np.array(spans).T
    for a, b in known:
        low, high = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b)
        if low < high:
            tags[low:high] = INSIDE
            tags[low] = BEGIN
    return tags


#: What may name a value, and what may stand between the two, in rewritten surroundings.
_NAMES = ["pwd", "bearer", "credential", "private", "access", "client", "session", "signature", "license", "webhook"]
_BETWEEN = ["=", " = ", ": ", ":", " ", ' = "', '="', ": '", " => ", " is ", '": "']
_SMALL, _CAPITAL, _BOTH = string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters


def _secret_value(rng: random.Random, named: bool) -> str:
    """A value of random characters in one of several forms; short ones only after a name."""

    def drawn(letters: str, least: int, most: int) -> str:
        return "".join(rng.choices(letters, k=rng.randint(least, most)))

    form = rng.randrange(8 if named else 7)
    if form < 2:
        return drawn(_BOTH + string.digits * 2, 16, 44)
    if form == 2:
        return drawn(_SMALL + string.digits * 2, 16, 44)
    if form == 3:
        return drawn(_CAPITAL + string.digits * 2, 16, 36)
    if form == 4:
        return drawn("0123456789abcdef", 20, 64)
    if form == 5:
        return drawn(_SMALL, 2, 4) + rng.choice("_-") + drawn(_BOTH + string.digits * 2, 20, 40)
    if form == 6:
        return drawn(_BOTH + string.digits * 2 + "+/._-", 24, 64) + rng.choice(["", "", "=", "=="])
    return drawn(_BOTH + string.digits * 3 + "!#@.", 8, 16)


def _plain_value(rng: random.Random, words: list[str]) -> str:
    """A number, date, version, address, name with digits or line of code: nothing secret."""

    def short() -> str:
        letters = "".join(rng.choices(rng.choice([_SMALL, _CAPITAL]), k=rng.randint(1, 4)))
        return rng.choice([f"{letters}{n % 10_000}", f"{letters}_{n % 10}", f"{n % 10}{letters}", f"{letters[0]}{n % 10}{letters}"])

    word, n = rng.choice(words), rng.randint(0, 99_999)
    day = f"20{rng.randint(10, 39)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
    return rng.choice(
        [
            str(rng.randrange(10 ** rng.randint(1, 18))),
            day,
            f"{day}T{rng.randint(0, 23):02}:{n % 60:02}:00Z",
            f"{n % 9}.{n % 17}.{n % 23}",
            f"{n % 250}.{n % 251}.{n % 252}.{n % 253}",
            f"+{n % 90} ({n % 900}) 555-{n % 10_000:04}",
            f"{word}.{n % 99}@mail{n % 9}.example.com",
            f"{word}{n % 1_000}",
            f"{word}_{n}_{rng.choice(words)}",
            f"{word.upper()}{n}",
            f"{word}{n % 100}{rng.choice(words).capitalize()}",
            f"{word}-{n % 2_100}.csv",
            f"https://{word}{n % 9}.example.com/{rng.choice(words)}/{n}",
            "".join(rng.choices(words, k=5)),
            "".join(w.capitalize() for w in rng.choices(words, k=rng.randint(2, 4))) + str(n % 12),
            word + "".join(w.capitalize() for w in rng.choices(words, k=rng.randint(1, 3))) + str(n % 12),
            short(),
            f"{short()} and {short()}",
            f"{short()} = {short()}[{n % 10}] + {n % 100};",
            f'"{short()}": {n}, "{word}": "{short()}"',
            f"{word}({short()}, {n % 100})",
            word,
        ]
    )


def rewritten(before: str, name: str, value: str, after: str, words: list[str], secret: bool, rng: random.Random) -> tuple[np.ndarray, np.ndarray] | None:
    """Features and tags of surroundings of a value, with another name, separator and value.

    Words of other places stand next to it, so that no single word comes to mark a place without secrets.
    """
    before = f"{before.rstrip()} {' '.join(rng.choices(words, k=rng.randint(0, 4)))}"
    after = f"{' '.join(rng.choices(words, k=rng.randint(0, 4)))} {after.lstrip()}"
    kind = rng.randrange(5)
    said = "" if kind < 2 else name if kind == 2 else rng.choice(_NAMES) if kind == 3 else rng.choice(words)
    said = said.upper() if rng.random() < 0.15 else said
    between = rng.choice(_BETWEEN) if said else ""
    if said and rng.random() < 0.2:  # a word or two between the name and the value
        between = f" {' '.join(rng.choices(words, k=rng.randint(1, 2)))} "
    if not secret:
        new = _plain_value(rng, words)
    elif rng.random() < 0.2 and len(value) >= 16:
        new = value
    else:
        new = _secret_value(rng, bool(said) and between.strip() not in ("", "is"))
    start = before.rstrip() + rng.choice([" ", "\n"]) + said + between
    ends = next((c for c in "\"'" if between.endswith(c)), "")
    text = start + new + ends + rng.choice([" ", "\n", ". ", ", "]) + after.lstrip()
    at = (len(start), len(start) + len(new))
    for spans, features in stretches(text):
        tags = _tags(spans, [at] if secret else [])
        if spans[0][0] <= at[0] and at[1] <= spans[-1][1]:
            return features[:PART], tags[:PART].astype(np.int64)
    return None


def _around(text: str, at: int, base: list[tuple[int, int, int]], known: list[tuple[int, int]], reach: int = 160) -> list[str]:
    """What stands before, names, is, and stands after the value that holds the place ``at``."""
    a, b = next(((a, b) for a, b in known if a <= at < b), (at, at))
    start = min([x for x, _, y in base if x <= a and b <= y], default=a)
    name = _NAMING.match(text, start, a)
    return [text[max(0, start - reach) : start], name[0] if name else "", text[a:b], text[b : b + reach]]


def more_examples(around: list[tuple[str, str, str, str]], most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """About ``most`` rewritten surroundings, half of them harmless; the same in every run."""
    rng = random.Random(len(around))
    words = re.findall(r"[^\W\d_]+", " ".join(f"{a[0]} {a[3]}" for a in around)) or ["value"]
    out = []
    for i in range(most):
        made = rewritten(*around[i % len(around)], words, (i + i // len(around)) % 2 == 0, rng)
        if made:
            out.append(made)
    return out


def learn(docs: DataFrame, key: str, text: str, sample: int = SAMPLE, bounded: bool = True) -> Field | None:
    """Train on parts with a secret from all texts, on others from a fixed sample, and on rewritten ones.

    All are chosen by hashes and bounded: at most a quarter of STRETCHES hold a secret, as many and a
    half again are rewritten from those.
    """
    rows = docs.select(F.col(key).cast("long").alias("pick"), F.col(text).cast("string").alias("text"))
    chosen = rows.select("pick").filter("pick is not null").distinct().orderBy(F.xxhash64("pick"), "pick").limit(sample)

    def parts(secret: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                order, xs, ys, around = [], [], [], []
                for pick, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    base = base_spans(text or "")
                    if secret and not base:
                        continue
                    known = values(text or "")
                    for spans, features in stretches(text or ""):
                        tags = _tags(spans, known)
                        for low, high in parts_of(tags):
                            if tags[low:high].any() == secret:
                                order.append(pick)
                                xs.append(features[low:high].astype("<i4").tobytes())
                                ys.append(tags[low:high].tobytes())
                                around.append(_around(text, spans[low + int((tags[low:high] != OUT).argmax())][0], base, known) if secret else None)
                columns = [
                    pa.array(order, pa.int64()),
                    pa.array(xs, pa.binary()),
                    pa.array(ys, pa.binary()),
                    pa.array(around, pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["pick", "x", "y", "around"])

        return run

    def drawn(texts: DataFrame, secret: bool, most: int) -> pa.Table:
        found = texts.select("pick", "text").mapInArrow(lean(parts(secret)), "pick long, x binary, y binary, around array<string>")
        return found.orderBy(F.xxhash64("pick", "x"), "x").limit(most).toArrow()

    with_secret = drawn(rows.filter("pick is not null"), True, STRETCHES // 4)
    if not with_secret.num_rows:
        logging.getLogger(__name__).warning("no text holds a secret that the rules find: the field is not trained, the rules work alone")
        return None
    # at most ``sample`` ids
    around = [tuple(a) for a in with_secret.column("around").to_pylist()]
    rewrites = more_examples(around, min(3 * STRETCHES // 8, REWRITES * len(around)))
    others = drawn(rows.join(F.broadcast(chosen), "pick"), False, STRETCHES - with_secret.num_rows - len(rewrites))
    table = pa.concat_tables([with_secret, others])
    examples = rewrites + [
        (np.frombuffer(x, "<i4").reshape(-1, WIDTH), np.frombuffer(y, np.int8).astype(np.int64))
        for x, y in zip(table.column("x").to_pylist(), table.column("y").to_pylist(), strict=True)
    ]
    return train(examples, bounded=bounded)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id and its spans (kind, start, end), base ones first counted.

    Null and empty texts have no spans, null ids stay null (and train nothing), repeated rows give
    equal results, empty tables none. Places are code points, the end is exclusive.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, key, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                found = [all_spans(t or "", model.value) for t in part.column(1).to_pylist()]
                spans = [[{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in own] for own in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, spans array<struct<kind: string, start: long, stop: long>>")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every span replaced by ``mark``; ``length`` follows where it was known."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, key, text))
    place = docs.columns.index(text)

    def clean(value: str) -> str:
        out, end = [], 0
        for a, _, b in all_spans(value, model.value):
            if b > end:  # spans of several kinds may overlap
                if a >= end:
                    out += [value[end:a], mark]
                end = b
        return "".join([*out, value[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                new = [None if t is None else clean(t) for t in part.column(place).to_pylist()]
                columns = list(part.columns)
                columns[place] = pa.array(new, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    out = docs.mapInArrow(lean(run), docs.schema)
    if length and length in docs.columns:
        kind = docs.schema[length].dataType
        out = out.withColumn(length, F.when(F.col(length).isNotNull(), F.char_length(text).cast(kind)))
    return out.select(*docs.columns)
