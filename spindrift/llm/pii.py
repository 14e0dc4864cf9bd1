"""Personal data: base rules for e-mail, IP, card and phone, and a character BiLSTM-CRF that adds what they miss, secrets too.

The model is trained in numpy on the driver, from labelled spans: windows around base spans, and around values that are assigned to
a name like ``token`` or ``password``, of a bounded sample of documents; the
same windows with the span written in another usual way (the label stays); and windows with digits that hold none. It is
broadcast (its size is fixed), and runs wherever a text can hold a span: around every digit, "@" and "[at]". Windows of such a
stretch overlap; each is decoded, and every character takes its tag from the window in which it stands most
central, so one tag sequence for the whole text results. Its spans are added if they pass the check of their
kind (digits, Luhn, form) and touch no base span.

Defined cases: a null or empty text has no spans; repeated rows, null ids and extra columns stay as they are (but for columns named like an added one); an empty table, or
one without spans to learn from, gives base spans only.
"""

from __future__ import annotations

import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from spindrift.llm.common import without
from spindrift.llm.lstm_crf import Model, encode, pad, train

KINDS = ("email", "ip", "card", "phone")
#: What the model tells apart: the kinds of the base rules, and secrets (keys, tokens, passwords).
SEEN = (*KINDS, "secret")
#: Any span of 64 characters lies whole in one of the windows, which overlap by two thirds.
WINDOW, STRIDE, MARGIN = 96, 32, 24
#: Documents and windows to learn from, at most about.
TRAIN_DOCS, TRAIN_WINDOWS = 6_000, 700
#: Labels of secrets.
_ASSIGNED = re.compile(r"""\b(?:token|secret|password|passwd|api[_-]?key)\b\s{0,3}[:=]\s{0,3}["']?([A-Za-z0-9+/_-]{16,64})(?![A-Za-z0-9+/_-])""", re.I)

#: Fixed patterns of the contract (the e-mail's is in base_spans).
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]|[\[({]at[\])}]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  #: start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[Span]:
    """The contract's spans, ordered by start and kind."""
    found: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append((start, 0, done))
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) < 4 and int(p or 0) < 256 for part in m[0].split("."))]
        found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def labelled_spans(text: str) -> list[Span]:
    """What the model learns from: base spans, and assigned secrets that touch none."""
    base = base_spans(text)
    secrets = [(m.start(1), 4, m.end(1)) for m in _ASSIGNED.finditer(text)] if _DIGIT.search(text) else []
    return sorted([*base, *(s for s in secrets if not any(a < s[2] and s[0] < b for a, _, b in base))])


def stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text that can hold a span."""
    out: list[list[int]] = []
    for m in _HINT.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def windows(a: int, b: int) -> list[tuple[int, int]]:
    found = [(s, min(s + WINDOW, b)) for s in range(a, max(a + 1, b - WINDOW + STRIDE), STRIDE)]
    return found if found[-1][1] == b else [*found, (b - WINDOW, b)]


#: A kind's form beyond the base rules.
_FORMS = (
    re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[\[({]at[\])}]) ?[A-Za-z0-9-]+(?: ?(?:\.|[\[({]dot[\])}]) ?[A-Za-z0-9-]+)*(?:\.|[\[({]dot[\])}]) ?[A-Za-z]{2,}"),
    re.compile(r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){4,7}"),
    re.compile(r"[0-9]{4}(?:[ ./-]{1,3}[0-9]{2,6}){2,5}"),
    re.compile(r"\(?[0-9]{2,4}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){2,4}"),
    re.compile(r"(?=.{0,60}?[0-9].{0,60}?[0-9])(?=.{0,60}?[A-Za-z].{0,60}?[A-Za-z])[A-Za-z0-9+/_-]{16,64}"),
)


def plausible(kind: int, text: str) -> bool:
    digits = _digits(text)
    if not _FORMS[kind].fullmatch(text):
        return False
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind != 3 or (9 <= len(digits) <= 15 and not re.fullmatch(r"[0-9]+(\.[0-9]+){3}", text))


def _reworded(kind: int, span: str, rng: random.Random) -> str:
    """The same datum in another usual form."""
    if kind == 0:
        at, dot = rng.choice([("[at]", "."), (" [at] ", "[dot]"), ("(at)", "."), (" (at) ", " (dot) "), ("@", "[dot]")])
        return span.replace("@", at).replace(".", dot) if dot != "." else span.replace("@", at)
    if kind == 1:
        return ":".join(f"{rng.randrange(65536):x}" for _ in range(8)) if rng.random() < 0.5 else span
    if kind == 2:
        d = _digits(span)
        return rng.choice([" ", "-", ".", " - "]).join(d[k : k + 4] for k in range(0, len(d), 4))
    if kind == 4:
        letters = rng.choice(["0123456789abcdef", "0123456789ABCDEF", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "_-"])
        return "".join(rng.choice(letters) for _ in range(rng.choice([20, 24, 32, 40, 40, 48])))
    d = _digits(span)
    return rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "{}/{}-{}"]).format(d[-10:-7] or "555", d[-7:-4], d[-4:])


def _renamed(before: str, rng: random.Random) -> str:
    """What stands before an assigned secret, with another name and sign."""
    name = "".join(rng.choice(string.ascii_lowercase + "_") for _ in range(rng.randrange(3, 10)))
    return re.sub(r"""[\w-]+\s*[:=]\s*["']?$""", lambda _: name + rng.choice([" = ", "=", ": ", ":", " "]) + rng.choice(['"', "'", ""]), before)


def _tags(length: int, spans: list[Span], start: int) -> np.ndarray:
    """0, or 1 + 2 * kind on a span's first character and 2 + 2 * kind on the others."""
    tags = np.zeros(length, np.int64)
    for a, kind, b in spans:
        a, b = a - start, b - start
        if 0 <= a and b <= length:
            tags[a], tags[a + 1 : b] = 1 + 2 * kind, 2 + 2 * kind
    return tags


def learn(docs: DataFrame, text_col: str = "text", seed: int = 11) -> Model | None:
    """Train on a bounded sample of documents: about TRAIN_DOCS read, about TRAIN_WINDOWS windows of them used."""
    total = max(1, docs.count())
    share = min(1.0, TRAIN_DOCS / total)
    picked = docs.select(F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                spans = labelled_spans(text or "")
                for a, b in stretches(text or ""):
                    inside = [s for s in spans if a <= s[0] and s[2] <= b]
                    if b - a <= 2 * WINDOW and len(inside) < 3:
                        rows.append((text[a:b], [x - (a if k != 1 else 0) for s in inside for k, x in enumerate(s)], bool(inside)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.list_(pa.int64()), pa.bool_()))], ["text", "spans", "some"])

    found = picked.where(F.col("text").rlike(_HINT.pattern)).mapInArrow(run, "text string, spans array<long>, some boolean").dropDuplicates(["text"])
    order = F.xxhash64(F.lit(seed), "text")
    with_span = found.where("some").orderBy(order, "text").limit(TRAIN_WINDOWS // 2).collect()
    without = found.where("not some").orderBy(order, "text").limit(TRAIN_WINDOWS // 4).collect()
    if not with_span:
        return None
    rng, texts, tags = random.Random(seed), [], []
    for row in [*with_span, *without]:
        spans = [tuple(row["spans"][k : k + 3]) for k in range(0, len(row["spans"]), 3)]
        texts.append(encode(row["text"]))
        tags.append(_tags(len(row["text"]), spans, 0))
        for (a, kind, b), _ in [(s, n) for s in spans for n in range(2)] if len(spans) == 1 else []:
            new, before = _reworded(kind, row["text"][a:b], rng), row["text"][:a] if kind != 4 else _renamed(row["text"][:a], rng)
            text, a = before + new + row["text"][b:], len(before)
            texts.append(encode(text))
            tags.append(_tags(len(text), [(a, kind, a + len(new))], 0))
    return train(texts, tags, 1 + 2 * len(SEEN), epochs=14, batch=96, rate=0.02, seed=seed)


def model_spans(model: Model, texts: list[str], rows: int = 1024) -> list[list[Span]]:
    """Spans that the model sees in each text."""
    found: list[list[Span]] = [[] for _ in texts]
    jobs = [(k, a, b, s, e) for k, text in enumerate(texts) for a, b in stretches(text) for s, e in windows(a, b)]
    jobs.sort(key=lambda j: j[4] - j[3])
    stretch_tags: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for first in range(0, len(jobs), rows):
        part = jobs[first : first + rows]
        codes, lengths = pad([encode(texts[k][s:e]) for k, _, _, s, e in part])
        for (k, a, b, s, e), tags in zip(part, model.decode(codes, lengths)):
            best, central = stretch_tags.setdefault((k, a), (np.zeros(b - a, np.int64), np.full(b - a, -1)))
            here = np.arange(e - s)
            depth = np.minimum(here if s > a else e - s, (e - s - 1 - here) if e < b else e - s)
            depth = np.broadcast_to(depth, here.shape)
            better = depth > central[s - a : e - a]
            best[s - a : e - a][better] = tags[better]
            central[s - a : e - a][better] = depth[better]
    for (k, a), (tags, _) in sorted(stretch_tags.items()):
        start = None
        for p, tag in enumerate([*tags.tolist(), 0]):
            if start is not None and tag != start[1]:
                found[k].append((a + start[0], (start[1] - 2) // 2, a + p))
                start = None
            if tag % 2 == 1:
                start = (p, tag + 1)
    return found


def all_spans(model: Model | None, texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
    """(base, all) of each text."""
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    more = model_spans(model, texts) if model else [[] for _ in texts]
    out = []
    for text, own, seen in zip(texts, base, more):
        added = []
        for a, kind, b in seen:
            while b > a and text[b - 1] in " .,-/":
                b -= 1
            if kind == 3 and a and text[a - 1] == "(" and ")" in text[a:b]:
                a -= 1
            if plausible(kind, text[a:b]) and not any(a < y and x < b for x, _, y in own):
                added.append((a, kind, b))
        out.append((own, sorted([*own, *added])))
    return out


def shown(spans: list[Span]) -> str:
    return ",".join(f"{SEEN[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """All columns but the text, with n_email, n_ip, n_card, n_phone (long, base spans), base_spans and spans (strings), n_added (long: spans of the model)."""
    docs = without(docs, (*[f"n_{k}" for k in KINDS], "base_spans", "spans", "n_added"))
    model = model or learn(docs, text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != text_col]
    schema = StructType([docs.schema[c] for c in kept])
    for k in KINDS:
        schema = schema.add(f"n_{k}", LongType())
    schema = schema.add("base_spans", StringType()).add("spans", StringType()).add("n_added", LongType())

    def run(batches):
        for batch in batches:
            *own, texts = batch.columns
            found = all_spans(held.value, texts.to_pylist())
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([*own, *counts, pa.array([shown(b) for b, _ in found], pa.string()), pa.array([shown(a) for _, a in found], pa.string()), pa.array([len(a) - len(b) for b, a in found], pa.int64())], schema.names)

    return docs.select(*kept, text_col).mapInArrow(run, schema)


def redact(text: str, spans: str) -> str:
    """The text with each span of a ``spans`` string replaced by its kind."""
    out, at = [], 0
    for span in filter(None, spans.split(",")):
        kind, a, b = span.split(":")
        if int(a) >= at:
            out += [text[at : int(a)], f"[{kind}]"]
            at = int(b)
    return "".join([*out, text[at:]])
