"""Personal data: fixed patterns, and candidate spans judged by gradient-boosted trees.

``base_spans`` are the plain patterns (email, ip, card, phone), found in one pass over the runs of digits and the ``@`` and ``+``
signs of a text, in linear time. The method adds to them: generators of high recall propose spans, which may overlap, for what
those patterns leave out (disguised addresses, national phone numbers, identity numbers, credentials, IPv6, IBAN); a boosted
model scores each from its format and context; of those over their kind's threshold, the best of each overlap is kept. The model is trained
on ``TRAIN_ROWS`` labelled spans made from a fixed seed: a third of them fits the trees, another calibrates them, and on the last the
thresholds are set for ``PRECISION``.

Cases: null text is empty; texts of any length are searched whole; repeated rows get equal results; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.trees import Boosted, fit_boosted, threshold_for

#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")
BASE_KINDS = KINDS[:4]
TRAIN_ROWS = 6000
PRECISION = 0.97
CONTEXT = 32


class Span(NamedTuple):
    start: int
    kind: int
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


# --- base patterns ---

_ZONE = re.compile(r"[0-9][\x20().0-9-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield Span(start, 0, done)
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str, zones: list[tuple[int, int]] | None = None) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, those that fail its test dropped; by start, then kind."""
    out = list(_emails(text)) if "@" in text else []
    for lo, hi in zones if zones is not None else number_zones(text):
        if hi - lo < 7:
            continue
        for m in _IP.finditer(text, lo, hi):
            if all(len(x) < 4 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m[0].split("."))):
                out.append(Span(m.start(), 1, m.end()))
        for m in _CARD.finditer(text, lo, hi):
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(Span(m.start(), 2, m.end()))
    if "+" in text:
        out += [Span(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    out.sort()
    return out


def number_zones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _ZONE.finditer(text)]


# --- candidates ---

_CUES = (
    re.compile(r"(?i)\b(?:tel|phone|telephone|call|mobile|cell|fax|telefon|tél|teléfono|whatsapp|ruf)\b"),
    re.compile(r"(?i)\b(?:e-?mail|mail|contact|correo|courriel|kontakt|write to)\b"),
    re.compile(r"(?i)\b(?:ssn|social security|national id|passport|tax id|nss|dni|steuer-?id)\b"),
    re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|konto|account|iban)\b"),
    re.compile(r"(?i)(?:password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key|bearer|authorization|private[_-]?key)"),
    re.compile(r"(?i)\b(?:ip|host|server|addr|address|client|from)\b"),
    re.compile(r"(?i)\b(?:version|v|isbn|issn|doi|page|pp|vol|chapter|§|order|invoice|build|section|fig|table|no)\b\.?"),
)
_AT = r"[\x20]?(?:\[at\]|\(at\)|\{at\}|<at>)[\x20]?|[\x20]at[\x20]"
_DOT = r"[\x20]?(?:\[dot\]|\(dot\)|\{dot\})[\x20]?|[\x20]dot[\x20]|\."
_VEILED = re.compile(rf"(?i)(?<![\w.+-])[a-z0-9][a-z0-9._+-]{{1,63}}(?:{_AT})[a-z0-9-]{{2,63}}(?:(?:{_DOT})[a-z0-9-]{{2,63}}){{1,4}}")
_VEIL_HINT = re.compile(r"(?i)[\[({< ]at[\])}> ]\s?[a-z0-9-]+(?:\.| ?[\[({ ]dot)")
_SSN = re.compile(r"(?<![0-9.-])[0-9]{3}([\x20-])[0-9]{2}\1[0-9]{4}(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9.+-])\(?[0-9]{2,4}\)?[\x20./-][0-9]{2,4}[\x20./-][0-9]{2,4}(?:[\x20./-][0-9]{2,4}){0,2}(?![0-9-])")
_KEY_CUE = r"(?i)(?:password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key|bearer|authorization|private[_-]?key)"
_CUE_WORD = re.compile(_KEY_CUE)
_KEYED = re.compile(_KEY_CUE + r"[\"']?[\x20]{0,3}[:=]?[\x20]{0,3}[\"']?([A-Za-z0-9_+/=.$!@#%&*~-]{6,})")
_KEY_HINT = re.compile(r"(?i)pass|pwd|token|secret|key|bearer|authorization")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*[0-9])[A-Za-z0-9_/+-]{18,}+={0,2}(?![A-Za-z0-9_/+=-])")
_IPV6 = re.compile(r"(?i)(?<![0-9a-z:])(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{1,4}(?![0-9a-z:])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")


def _keyed(text: str) -> Iterator[Span]:
    """What follows a cue word. If that is itself a cue (``Authorization: Bearer ...``), also what follows it."""
    m = _KEYED.search(text)
    while m:
        yield Span(m.start(1), 6, m.end(1))
        m = _KEYED.search(text, m.start(1) if _CUE_WORD.fullmatch(m[1]) else m.end(1))


def candidates(text: str, zones: list[tuple[int, int]]) -> list[Span]:
    """Spans that may be personal data, whatever their overlaps."""
    out = []
    if _VEIL_HINT.search(text):
        out += [Span(m.start(), 0, m.end()) for m in _VEILED.finditer(text)]
    for lo, hi in zones:
        if hi - lo >= 9:
            near = max(0, lo - 1), hi
            out += [Span(m.start(), 4, m.end()) for m in _SSN.finditer(text, *near)]
            out += [Span(m.start(), 3, m.end()) for m in _NATIONAL.finditer(text, *near)]
    if zones or "=" in text or ":" in text:
        if _KEY_HINT.search(text):
            out += _keyed(text)
    seen = -1
    for lo, hi in zones:  # opaque tokens, IBAN and IPv6 hold digits: look at the word around each
        if lo < seen:
            continue
        start, end = lo, hi
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        seen = end
        if end - start >= 15:
            out += [Span(m.start(), 6, m.end()) for m in _OPAQUE.finditer(text, start, end)]
            out += [Span(m.start(), 5, m.end()) for m in _IBAN.finditer(text, start, min(len(text), end + 30))]
        if end - start >= 5 and text.count(":", start, end) >= 2:
            out += [Span(m.start(), 1, m.end()) for m in _IPV6.finditer(text, start, end)]
    return sorted(set(out))


def _entropy(x: str) -> float:
    n = len(x)
    return -sum(c / n * math.log2(c / n) for c in (x.count(k) for k in set(x)))


def _iban_ok(x: str) -> bool:
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1 if x.isalnum() and x.isascii() else False


def _ip_ok(x: str) -> bool:
    try:
        return ipaddress.ip_address(x) is not None
    except ValueError:
        return False


def describe(text: str, span: Span) -> list[float]:
    """Format and context features of a span."""
    x = text[span.start : span.end]
    before, after = text[max(0, span.start - CONTEXT) : span.start], text[span.end : span.end + 8]
    digits = [c for c in x if "0" <= c <= "9"]
    groups = [g for g in re.split(r"[^0-9]+", x) if g]
    row = [
        float(span.kind),
        float(len(x)),
        len(digits) / len(x),
        float(len(digits)),
        float(len(groups)),
        float(len(groups[0])) if groups else 0.0,
        float(len(groups[-1])) if groups else 0.0,
        sum(c.isupper() for c in x) / len(x),
        sum(c.isalpha() for c in x) / len(x),
        float(sum(not c.isalnum() for c in x)),
        _entropy(x),
        float(sum(a.isdigit() != b.isdigit() for a, b in zip(x, x[1:]))),
        float("dot" in x.lower() or "(" in x or "[" in x),
        float(_iban_ok(x)) if span.kind == 5 else 0.0,
        float(_ip_ok(x)) if span.kind == 1 else 0.0,
        float(bool(re.search(r"[:=]\s*[\"']?\Z", before))),
        float(bool(groups) and groups[0] in ("000", "666") or bool(groups) and span.kind == 4 and groups[0] > "899"),
        float(bool(groups) and len(groups[0]) == 4 and groups[0][:2] in ("19", "20")),
        float(bool(re.match(r"[A-Za-z0-9]", after))),
    ]
    return row + [max((m.end() for m in cue.finditer(before)), default=-1.0) - len(before) + 33.0 if cue.search(before) else 0.0 for cue in _CUES]


# --- training ---


def training_table(rows: int = TRAIN_ROWS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """``rows`` labelled spans: texts made from a seed, with the candidates that the generators find in them."""
    rng = random.Random(seed)
    pick = rng.choice
    d = lambda n: "".join(pick("0123456789") for _ in range(n))
    a = lambda n, s="abcdefghijklmnopqrstuvwxyz": "".join(pick(s) for _ in range(n))
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    ssn = lambda: f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"

    def iban() -> str:
        body = pick(("DE", "FR", "ES", "GB", "NL"))
        rest = d(pick((16, 18, 20)))
        check = 98 - int("".join(str(int(c, 36)) for c in rest + body + "00")) % 97
        return f"{body}{check:02d}{rest}"

    word = lambda: a(rng.randint(2, 9))
    dot = lambda: pick((" dot ", "[dot]", " (dot) ", "."))
    yes = (
        lambda: (pick(("", "mail ", "contact: ")), f"{word()}.{word()}{pick((' [at] ', '[at]', ' (at) ', '(at)'))}{word()}{dot()}{pick(('com', 'org', 'net'))}", 0),
        lambda: (pick(("mail ", "write to ")), f"{word()}{d(2)} at {word()} dot {pick(('com', 'org', 'net'))}", 0),
        lambda: (pick(("tel ", "call ", "phone: ", "Tel. ", "")), pick((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}")), 3),
        lambda: (pick(("SSN ", "ssn: ", "social security number ", "")), ssn(), 4),
        lambda: (pick(("IBAN ", "")), iban(), 5),
        lambda: (pick(("password=", "pwd: ", 'token = "', "api_key=", "secret: ")), pick((a(rng.randint(12, 40), "0123456789abcdef"), a(rng.randint(8, 30), mixed + "!$%"))) + d(2), 6),
        lambda: (word() + " ", "AKIA" + a(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 6),
        lambda: (word() + " ", pick(("ghp_", "sk-", "xoxb-")) + a(rng.randint(24, 40), mixed) + d(1), 6),
        lambda: (pick(("key ", "token ", "")), a(pick((32, 40, 64)), "0123456789abcdef"), 6),
        lambda: (pick(("ip ", "from ", "")), ":".join(a(rng.randint(1, 4), "0123456789abcdef") for _ in range(8)), 1),
    )
    no = (
        lambda: (pick(("version ", "v", "build ")), f"{d(1)}.{d(2)}.{d(3)}", 3),
        lambda: (pick(("on ", "", "date ")), f"{pick((19, 20))}{d(2)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", 3),
        lambda: (pick(("pages ", "pp ", "no. ", "order ")), f"{d(3)} {d(3)} {d(3)}", 3),
        lambda: (pick(("isbn ", "ISBN ")), f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", 3),
        lambda: (pick(("", "about ")), f"{d(2)} {d(3)} {d(3)}", 3),
        lambda: (pick(("at ", "from ")), f"{rng.randint(10, 23)}:{d(2)}:{d(2)}", 1),
        lambda: (pick(("see ", "")), f"{word()}-{word()}-{word()}-{word()}-{d(4)}", 6),
        lambda: ("", f"{word()}/{word()}/{word()}/{word()}/{d(2)}", 6),
        lambda: (pick(("the password ", "a token ", "secret ", "key ")), a(rng.randint(6, 12)), 6),
        lambda: ("", f"{word()} at {word()}.{word()}", 0),
        lambda: (pick(("look at ", "was ")), f"{word()} at {word()}. {word()}", 0),
        lambda: ("", f"000-{d(2)}-{d(4)}", 4),
        lambda: ("order ", f"9{d(2)}-{d(2)}-{d(4)}", 4),
        lambda: ("", f"AB{d(2)} {a(4, 'ABCDEFGHIJ')} {a(4, 'ABCDEFGHIJ')}", 5),
    )
    xs, ys = [], []
    while len(xs) < rows:
        good = rng.random() < 0.5
        lead, value, _ = pick(yes if good else no)()
        prose = lambda: " ".join(word() for _ in range(rng.randint(3, 8)))
        head = f"{prose()}{pick((' ', '. ', ', ', chr(10)))}{lead}"
        text = f"{head}{value}{pick((' ', '. ', ', ', chr(34) + ' '))}{prose()}"
        lo, hi = len(head), len(head) + len(value)
        taken = base_spans(text)
        for span in candidates(text, number_zones(text)):
            if not any(b.start <= span.start and span.end <= b.end for b in taken):
                xs.append(describe(text, span))
                ys.append(bool(good and span.start >= lo - 1 and span.end <= hi + 1 and span.end - span.start >= 0.8 * (hi - lo)))
    return np.array(xs[:rows]), np.array(ys[:rows])


class Model(NamedTuple):
    trees: Boosted
    thresholds: tuple[float, ...]


def train(rows: int = TRAIN_ROWS, precision: float = PRECISION) -> Model:
    x, y = training_table(rows)
    fitted = np.arange(len(x)) % 3 != 2
    trees = fit_boosted(x[fitted], y[fitted], rounds=25, depth=4)
    held = ~fitted
    p, kind = trees.probability(x[held]), x[held][:, 0]
    return Model(trees, tuple(max(0.5, threshold_for(p[kind == k], y[held][kind == k], precision)) for k in range(len(KINDS))))


# --- selection ---


def find(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """For each text: its base spans, and all spans."""
    bases, proposed, rows, owner = [], [], [], []
    for k, text in enumerate(texts):
        zones = number_zones(text)
        base = base_spans(text, zones)
        bases.append(base)
        for span in candidates(text, zones):
            met = [b for b in base if b.start < span.end and span.start < b.end]
            # A long token may hold digits that look like a card: as a whole it is still a secret.
            if not met or span.kind == 6 and all(span.start <= b.start and b.end <= span.end and b.end - b.start < span.end - span.start for b in met):
                proposed.append(span)
                rows.append(describe(text, span))
                owner.append(k)
    chosen: list[list[Span]] = [[] for _ in texts]
    if rows:
        p = model.trees.probability(np.array(rows))
        for i in sorted(range(len(rows)), key=lambda i: (-p[i], proposed[i])):
            span, own = proposed[i], chosen[owner[i]]
            if p[i] >= model.thresholds[span.kind] and not any(s.start < span.end and span.start < s.end for s in own):
                own.append(span)
    return [(base, sorted(base + own)) for base, own in zip(bases, chosen)]


def find_pii(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    model = model or train()
    kind = dict(docs.dtypes)["doc_id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find([t or "" for t in batch.column("text").to_pylist()], model)
            out = {"doc_id": batch.column("doc_id")}
            for k, name in enumerate(BASE_KINDS):
                out[f"n_{name}"] = pa.array([sum(s.kind == k for s in base) for base, _ in found], pa.int64())
            out["base_sha256"] = pa.array([hashlib.sha256(",".join(map(str, base)).encode()).hexdigest() for base, _ in found], pa.string())
            out["spans"] = pa.array([",".join(map(str, spans)) for _, spans in found], pa.string())
            out["n_added"] = pa.array([len(spans) - len(base) for base, spans in found], pa.int64())
            yield pa.RecordBatch.from_pydict(out)

    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; other columns as they are."""
    model = model or train()
    schema = docs.schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = []
            for text, (_, spans) in zip(texts, find([t or "" for t in texts], model)):
                parts, at = [], 0
                for s in spans:
                    if s.start >= at:
                        parts += [text[at : s.start], f"[{KINDS[s.kind].upper()}]"]
                        at = s.end
                    else:
                        at = max(at, s.end)
                out.append(None if text is None else "".join(parts) + text[at:])
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    return docs.mapInArrow(scan, schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
