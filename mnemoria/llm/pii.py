"""Operator 7: personal data by candidate generation and gradient boosting.

Strict patterns give the base spans. Generators of high recall then propose further spans, which
may overlap; boosted trees score each proposal from its format and from the words around it, and
thresholds calibrated for each kind select what is redacted. The trees are trained here, on a
bounded number of synthetic examples that a seed fixes.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import Trees, boost

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "mac", "ipv6", "secret")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# No match can begin inside a run of digits, so the look-behind only saves time on long runs.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    values = [int(digit) for digit in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * value, 10)) for value in values[1::2])) % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Grows each ``@`` to the left and right; linear, and the same matches as the pattern's."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            end = domain.end()
            yield "email", start, end
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[Span]:
    """The spans of the strict patterns, by kind and start; kinds may overlap each other."""
    found = list(emails(text)) if "@" in text else []
    if text.count(".") >= 3:
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return found


# Generators: the kind proposed and the pattern; loose on purpose.
GENERATORS = (
    ("email", re.compile(r"(?<![\w.])[A-Za-z0-9._%+-]{1,64} ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?[A-Za-z0-9-]{1,63}(?: ?[\[({<]? ?(?:dot|DOT|\.) ?[\])}>]? ?[A-Za-z0-9-]{2,63}){1,4}"), re.compile(r"[\[({<] ?(?:at|AT|@)")),
    ("phone", re.compile(r"(?<![\w.+-])(?![0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![\w-]))\(?[0-9](?:[ ().\-/]{0,2}[0-9]){7,14}(?![\w-])"), None),
    ("card", re.compile(r"(?<![\w.-])[0-9]{4}(?:[./_]?[0-9]){9,15}(?!\w)"), None),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![\w-])"), None),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?!\w)"), None),
    ("mac", re.compile(r"(?<![\w:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![\w:-])"), re.compile(r"[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]")),
    ("ipv6", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,5}(?![\w:])"), re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f:]")),
    ("secret", re.compile(r"(?<![\w/+-])[A-Za-z0-9_/+-]{20,}+={0,2}(?![\w/+-])"), None),
)

CUES = (
    re.compile(r"(?:tel|phone|call|mobile|cell|fax|whatsapp|contact|sms)\W{0,8}(?:\w{1,8}\W{1,4})?$", re.I),
    re.compile(r"(?:mail|contact|write|reach|send)\W{0,8}(?:\w{1,8}\W{1,4}){0,2}$", re.I),
    re.compile(r"(?:card|visa|mastercard|amex|credit|debit|cc)\W{0,8}(?:\w{1,8}\W{1,4})?$", re.I),
    re.compile(r"(?:ssn|social security|security number|tax id)\W{0,8}(?:\w{1,8}\W{1,4})?$", re.I),
    re.compile(r"(?:iban|account|bank|acct)\W{0,8}(?:\w{1,8}\W{1,4})?$", re.I),
    re.compile(r"(?:token|secret|password|passwd|api[_ -]?key|access[_ -]?key|auth|bearer|credential|private)\w{0,12}\W{0,8}$", re.I),
    re.compile(r"(?:order|invoice|isbn|issn|version|ref|part|model|serial|article|no|nr|id|page|year|date|price|total|sha|md5|commit|hash|digest|doi)\W{0,8}$", re.I),
)
PREFIXED = re.compile(r"(?:AKIA|ASIA|ghp_|gho_|glpat-|sk-|sk_live_|xox[abp]-|AIza|eyJ)")
HEXADECIMAL = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
CONTEXT = 32


@dataclass(frozen=True)
class Model:
    trees: Trees
    thresholds: dict[str, float]


def entropy(text: str) -> float:
    counts = [text.count(c) for c in set(text)]
    return -sum(n / len(text) * math.log2(n / len(text)) for n in counts) if text else 0.0


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """Format and context of a proposal, over its whole length; the cost is linear in it."""
    span = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + 4]
    digits = NOT_DIGIT.sub("", span)
    groups = re.findall(r"[0-9]+", span)
    letters = sum(map(str.isalpha, span))
    compact = re.sub(r"\s+", "", span)
    mod97 = kind == "iban" and compact.isascii() and compact.isalnum() and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1
    return [
        *(float(kind == other) for other in KINDS),
        float(end - start), float(len(digits)), float(letters), float(len(span) - len(digits) - letters),
        float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)), float(len(groups[-1]) if groups else 0),
        float("(" in span), float(span.count("-")), float(span.count(".")), float(span.count("/")), float(span.count(" ")),
        float(bool(digits) and luhn(digits)), float(mod97), entropy(span), float(bool(HEXADECIMAL.fullmatch(span))),
        float(any(map(str.islower, span)) and any(map(str.isupper, span))), float(bool(PREFIXED.match(span))),
        *(float(bool(cue.search(before))) for cue in CUES),
        float(before[-1:] in "\"'`" and before != ""), float(before[-1:] in "$€£#" and before != ""), float(after[:1] in "%€$°" and after != ""), float("=" in before[-4:] or ":" in before[-3:]),
    ]


def proposals(text: str) -> list[Span]:
    found = []
    for kind, pattern, needs in GENERATORS:
        if needs is None or needs.search(text):
            for m in pattern.finditer(text):
                if kind == "secret" and not any(map(str.isdigit, m[0])):
                    continue
                found.append((kind, m.start(), m.end()))
    return found


# ---- training examples -------------------------------------------------------------------

FILLER = ("the", "and", "of", "in", "is", "that", "for", "was", "with", "on", "le", "de", "et", "und", "der", "que", "los", "a", "by", "from")


def check_digit(digits: str) -> str:
    return next(d for d in "0123456789" if luhn(digits + d))


def example(rng: random.Random) -> tuple[str, str, bool]:
    """``(kind, text, private)``: a text with one proposal of the kind."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    pick = rng.choice
    word = lambda: "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    mixed = lambda k: "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    hexed = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))
    cue = ""
    kind, private = pick([k for k, *_ in GENERATORS]), rng.random() < 0.5
    if kind == "email":
        if private:
            span = f"{word()}{pick(['', '.', '_'])}{word()} {pick(['(at)', '[at]', '[AT]', '(AT)', '{at}'])} {word()}{pick([' (dot) ', ' [dot] ', '.', ' [DOT] '])}{pick(['com', 'org', 'net', 'de', 'example.com'])}"
            cue = pick(["", "mail ", "contact: ", "write to "])
        else:
            span = f"{word()} {pick(['(at)', '[at', '(at'])} {word()} {word()}"
    elif kind == "phone":
        if private:
            span = pick([f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"0{n(3)} {n(3)} {n(4)}", f"00{n(2)} {n(3)} {n(3)} {n(3)}", f"{n(3)}.{n(3)}.{n(4)}", f"0{n(2)} {n(2)} {n(2)} {n(2)} {n(2)}"])
            cue = pick(["phone: ", "call ", "tel. ", "mobile ", "fax ", "", ""]) if "(" in span or "-" in span else pick(["phone: ", "call ", "tel. ", "mobile "])
        else:
            span = pick([n(8), n(9), n(10), n(12), n(16), n(15), n(13), f"{n(4)}-{n(2)}-{n(2)}", f"{n(4)}/{n(2)}/{n(2)} {n(4)}", f"{n(2)}.{n(2)}.{n(4)}", f"{n(3)} {n(3)} {n(3)}", f"{n(4)} {n(4)} {n(4)} {n(4)}", f"{n(1)}.{n(8)}", f"{n(4)}-{n(4)}", f"{n(3)}-{n(10)}"])
            cue = pick(["", "", "order ", "isbn ", "total ", "no. ", "id: ", "in "])
    elif kind == "card":
        body = pick(["4", "5", "37", "6011"])
        body += n(15 - len(body))
        whole = body + (check_digit(body) if private else pick([d for d in "0123456789" if d != check_digit(body)]))
        span = pick([whole, ".".join(whole[k : k + 4] for k in range(0, 16, 4)), "/".join(whole[k : k + 4] for k in range(0, 16, 4))])
        cue = pick(["card ", "visa: ", "credit card ", ""]) if private else pick(["", "", "order ", "id ", "ref "])
    elif kind == "ssn":
        span = f"{n(3)}{pick('- ')}{n(2)}{pick('- ')}{n(4)}"
        cue = pick(["ssn ", "SSN: ", "social security number "]) if private else pick(["", "part no. ", "ref ", "in "])
    elif kind == "iban":
        body = n(18)
        country = pick(["DE", "FR", "ES", "NL"])
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        span = f"{country}{check if private else (check + rng.randint(1, 60)) % 97:02d}{body}"
        span = pick([span, " ".join(span[k : k + 4] for k in range(0, len(span), 4))])
        cue = pick(["iban ", "account ", ""]) if private else pick(["", "model ", "serial "])
    elif kind == "mac":
        span = pick(":-").join(hexed(2) for _ in range(6)) if private else "-".join(n(2) for _ in range(6))
        cue = pick(["", "mac ", "device "]) if private else pick(["date ", "in ", ""])
    elif kind == "ipv6":
        span = ":".join(hexed(4) for _ in range(8)) if private else pick([f"{n(2)}:{n(2)}:{n(2)}", f"{n(1)}:{n(2)}:{n(2)}", f"{n(4)}:{n(2)}:{n(2)}"])
        cue = pick(["", "host ", "from "])
    else:
        if private:
            span = pick([hexed(40), hexed(40).upper(), hexed(32), mixed(40), "AKIA" + mixed(16).upper(), "ghp_" + mixed(36), "sk-" + mixed(40), "xoxb-" + mixed(30)])
            cue = pick(['token = "', 'API_TOKEN = "', "api_key=", "secret: ", 'password = "', "Bearer ", "access_key: '"])
        else:
            span = pick([hexed(40), hexed(64), n(20), n(24), f"{word()}-{word()}-{word()}-{word()}-{n(2)}", f"{word()}_{word()}_{word()}_{word()}{n(1)}", f"{word()}/{word()}/{word()}/{word()}/{n(4)}", mixed(30), hexed(32)])
            cue = pick(["commit ", "sha ", "hash ", "", "", "md5: ", "doi "])
    left, right = " ".join(pick(FILLER) for _ in range(rng.randint(0, 6))), " ".join(pick(FILLER) for _ in range(rng.randint(0, 6)))
    return kind, f"{left}{pick([' ', ', ', '. ', chr(10)]) if left else ''}{cue}{span}{pick(['', ' ', '. ', ', ', chr(34)])} {right}", private


@lru_cache(maxsize=4)
def train(examples: int = 6000, seed: int = 7, precision: float = 0.98) -> Model:
    """Trees from two thirds of the examples; thresholds from the other third.

    A kind's threshold is the least at which ``precision`` of the calibration proposals above it are
    private; at least one half, and out of reach where no threshold does it.
    """
    rng = random.Random(seed)
    rows: list[tuple[str, list[float], bool]] = []
    for _ in range(examples):
        kind, text, private = example(rng)
        found = [span for span in proposals(text) if span[0] == kind]
        if found:
            _, start, end = max(found, key=lambda span: span[2] - span[1])
            rows.append((kind, features(kind, text, start, end), private))
    x, y = np.array([row[1] for row in rows]), np.array([row[2] for row in rows], dtype=float)
    split = 2 * len(rows) // 3
    trees = boost(x[:split], y[:split])
    p, thresholds = trees.probability(x[split:]), {}
    for kind in KINDS:
        own = np.array([row[0] == kind for row in rows[split:]], dtype=bool)
        order = np.argsort(-p[own], kind="stable")
        good = np.cumsum(y[split:][own][order]) / np.arange(1, len(order) + 1)
        fit = np.flatnonzero(good >= precision)
        thresholds[kind] = max(0.5, float(p[own][order][fit[-1]])) if len(fit) else 2.0
    return Model(trees, thresholds)


def covered(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint sorted stretches that spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for _, start, end in sorted(spans, key=lambda span: span[1]):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def free_place(starts: list[int], ends: list[int], start: int, end: int) -> int:
    """Where a span goes among disjoint sorted stretches; -1 if it overlaps one."""
    at = bisect_right(ends, start)
    return -1 if at < len(starts) and starts[at] < end else at


def find_spans(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """``(base, added)`` spans of each text; added ones overlap neither base spans nor each other."""
    results, stretches, rows, where = [], [], [], []
    for index, text in enumerate(texts):
        base = base_spans(text)
        results.append((base, []))
        stretches.append(covered(base))
        for kind, start, end in proposals(text):
            if free_place(*stretches[index], start, end) >= 0:
                rows.append(features(kind, text, start, end))
                where.append((index, kind, start, end))
    if rows:
        scores = model.trees.probability(np.array(rows))
        for k in np.argsort(-scores, kind="stable").tolist():
            index, kind, start, end = where[k]
            starts, ends = stretches[index]
            if scores[k] >= model.thresholds[kind] and (at := free_place(starts, ends, start, end)) >= 0:
                starts.insert(at, start)
                ends.insert(at, end)
                results[index][1].append((kind, start, end))
    return results


def written(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda span: (KINDS.index(span[0]), span[1], span[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each run of overlapping spans replaced by the kind of its first."""
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda span: (span[1], -span[2])):
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join((*parts, text[at:]))


def personal_data(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, base, spans, redacted`` of every whole text; both lists are of ``kind, start, end``.

    Offsets are code points, the end excluded. A null text has no spans and stays null; repeated
    rows are rows of their own; an empty table gives an empty one; other columns are ignored. Each
    task reads its own split and memory is bounded by one Arrow batch; there is no shuffle.
    """
    model = model or train()
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = find_spans([text or "" for text in texts], model)
            listed = [[[{"kind": kind, "start": start, "end": end} for kind, start, end in spans] for spans in (base, sorted(base + added, key=lambda span: (KINDS.index(span[0]), span[1], span[2])))] for base, added in found]
            redacted = [None if text is None else redact(text, base + added) if base or added else text for text, (base, added) in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row[0] for row in listed], span_type), pa.array([row[1] for row in listed], span_type), pa.array(redacted, pa.string())], names=[id_col, "base", "spans", "redacted"])

    spans = "array<struct<kind: string, start: long, end: long>>"
    return docs.select(id_col, text_col).mapInArrow(scan, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, base {spans}, spans {spans}, redacted string")


def redacted_documents(docs: DataFrame, model: Model | None = None, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with redacted texts; ``length_col`` follows the new text where the table has it.

    All other columns stay as they are. A null text stays null and keeps its length; repeated rows
    stay rows of their own; an empty table gives an empty one. There is no shuffle.
    """
    model = model or train()
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = find_spans([text or "" for text in texts], model)
            new = [text if text is None or not (base or added) else redact(text, base + added) for text, (base, added) in zip(texts, found, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if length_at is not None:
                lengths = [old if text is None else len(text) for text, old in zip(new, columns[length_at].to_pylist(), strict=True)]
                columns[length_at] = pa.array(lengths, batch.schema.field(length_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(scan, docs.schema)
