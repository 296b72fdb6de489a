"""Personal data: exact base matches, plus candidates judged by boosted trees.

Generators propose spans with high recall; they may overlap each other.  Every
candidate gets format features (digits, separators, checksums) and context features
(what stands before and after).  Boosted trees learn from candidates of a bounded
sample of documents and from constructed examples of every generator, labelled by
evidence of their own (``evident``), not by agreement with the base rules; Platt
scaling and a precision target on the other half set a threshold for each generator.
Base spans always stay; accepted candidates are added.
"""

from __future__ import annotations

import hashlib
import ipaddress
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, worker
from .trees import BoostedTrees, platt, sigmoid

#: Order of kinds at equal starts; the first four are base kinds.
KINDS = ["email", "ip", "card", "phone", "x_email", "x_number", "x_iban", "x_ipv6"]

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A digit run matches from its first digit or not at all, so later starts are skipped.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d)
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The characters before an at sign hold no at sign, so each one has one leftmost start."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kept, dropped) as (start, kind, end): matches that pass their check, and those that fail it."""
    kept = [(s, 0, e) for s, e in _emails(text)]
    dropped: list[tuple[int, int, int]] = []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            (kept if all(map(_small, m[0].split("."))) else dropped).append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            (kept if 12 <= len(digits) <= 19 and luhn(digits) else dropped).append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                n = sum(c.isascii() and c.isdigit() for c in m[0])
                (kept if 9 <= n <= 15 else dropped).append((m.start(), 3, m.end()))
    kept.sort()
    return kept, dropped


_X_NUMBER = re.compile(r"[+(]?(?<![0-9])[0-9][0-9\x20().\-/]{5,40}[0-9](?![0-9])")
_X_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_X_IPV6 = re.compile(r"(?<![0-9A-Za-z_:])[0-9A-Fa-f]{0,4}+(?::{1,2}[0-9A-Fa-f]{1,4}+){1,7}+(?:::)?(?![0-9A-Za-z_]|:[0-9A-Fa-f:])")
_AT_MARK, _DOT_MARK = r"(?i:\(at\)|\[at\])", r"(?i:\(dot\)|\[dot\])"
_X_EMAIL = re.compile(rf"[A-Za-z0-9._%+-]{{1,64}}\x20?(?:@|{_AT_MARK})\x20?[A-Za-z0-9-]{{1,63}}(?:\x20?(?:\.|{_DOT_MARK})\x20?[A-Za-z0-9-]{{1,63}}){{1,6}}")
#: The same without blanks around plain marks, so that a sentence behind an address is no part of it.
_X_EMAIL_TIGHT = re.compile(rf"[A-Za-z0-9._%+-]{{1,64}}(?:@|\x20?{_AT_MARK}\x20?)[A-Za-z0-9-]{{1,63}}(?:(?:\.|\x20?{_DOT_MARK}\x20?)[A-Za-z0-9-]{{1,63}}){{1,6}}")
_BREAK = re.compile(r"\.\x20|\x20\x20|\x20[-/]\x20")
_AT = re.compile(r"@|\((?i:at)\)|\[(?i:at)\]")
#: Words whose presence before a number or address is telling; fixed values.
_CUES = ["tel", "phone", "call", "mobile", "fax", "mail", "contact", "card", "visa", "credit", "account", "iban", "ssn", "ip", "host", "server", "address", "id", "order", "version", "page", "isbn", "year"]


def candidates(text: str) -> list[tuple[int, int, int]]:
    """High-recall proposals (start, kind, end); windows around telling characters keep this linear."""
    out = []
    done = 0
    for m in _AT.finditer(text):
        low = max(done, m.start() - 66)
        for c in _X_EMAIL.finditer(text, low, min(len(text), m.end() + 200)):
            if c.start() <= m.start() < c.end():
                out.append((c.start(), 4, c.end()))
                tight = _X_EMAIL_TIGHT.search(text, c.start(), c.end())
                if tight and tight.start() <= m.start() < tight.end() and tight.span() != c.span():
                    out.append((tight.start(), 4, tight.end()))
                done = c.end()
                break
    if _DIGIT.search(text):
        for m in _X_NUMBER.finditer(text):
            out.append((m.start(), 5, m.end()))
            cuts = [(b.start() + m.start(), b.end() + m.start()) for b in _BREAK.finditer(m[0])]
            for start, end in zip([m.start(), *(e for _, e in cuts)], [*(b for b, _ in cuts), m.end()], strict=True):
                if cuts and end - start >= 7:
                    out.append((start, 5, end))
        out += [(m.start(), 6, m.end()) for m in _X_IBAN.finditer(text)]
        if text.count(":") > 1:
            out += [(m.start(), 7, m.end()) for m in _X_IPV6.finditer(text) if "::" in m[0] or m[0].count(":") > 2]
    return out


def _iban(text: str) -> bool:
    s = text.replace(" ", "")
    s = s[4:] + s[:4]
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def _ipv6(text: str) -> bool:
    try:
        address = ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return _DIGIT.search(text) is not None and int(address) > 1  # unspecified and loopback name nobody


def _mail(text: str) -> bool:
    """Whether the mail rule holds once marks in brackets are read as signs."""
    plain = re.sub(rf"\x20?{_DOT_MARK}\x20?", ".", re.sub(rf"\x20?{_AT_MARK}\x20?", "@", text))
    return list(_emails(plain)) == [(0, len(plain))]


#: A blank that touches no mark in brackets.
_BLANK = re.compile(r"(?<![)\]])\x20(?![(\[])")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}([-\x20])(?!00)[0-9]{2}\1(?!0000)[0-9]{4}")
_SSN_CUE = re.compile(r"\b(?:ssn|social security)\b[^0-9]*$")
_PHONE_CUE = re.compile(r"\b(?:tel|telephone|phone|call|mobile|cell|fax|contact)\b[^0-9]*$")


def _local_phone(text: str, groups: list[str]) -> bool:
    """Groups of a national number: neither a date nor an address of four small numbers."""
    n = sum(map(len, groups))
    if not 7 <= n <= 12 or not 2 <= len(groups) <= 5 or max(map(len, groups)) > 8 or text[:1] == "+":
        return False
    date = len(groups) == 3 and sorted(map(len, groups))[1] <= 2 and any(g[:2] in ("19", "20") and len(g) == 4 for g in groups)
    return not date and not (len(groups) == 4 and text.count(".") == 3)


def evident(text: str, span: tuple[int, int, int]) -> bool:
    """Evidence in the candidate itself and the words before it; base matches play no part."""
    start, kind, end = span
    s = text[start:end]
    if kind == 4:
        return _mail(s)
    if kind == 6:
        return _iban(s)
    if kind == 7:
        return _ipv6(s)
    groups = [g for g in re.split(r"[^0-9]+", s) if g]
    digits = "".join(groups)
    if s[:1] == "+":
        return 9 <= len(digits) <= 15
    before = text[max(0, start - 24) : start].lower()
    card = 12 <= len(digits) <= 19 and luhn(digits) and not set(s) & set("()./")
    return card or bool(_SSN.fullmatch(s) and _SSN_CUE.search(before)) or bool(_PHONE_CUE.search(before)) and _local_phone(s, groups)


def _examples(n: int = 200) -> list[str]:
    """Constructed texts with true and false candidates of every generator: none depends on the sample for its positives."""
    r = random.Random(11)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexa = lambda: f"{r.randrange(1, 1 << 16):x}"
    out = []
    for i in range(n):
        name, site = f"{r.choice(['ann', 'bob', 'kim.lee', 'j_ross'])}{i}", r.choice(["corp", "mail-site", "uni", "shop"])
        at, dot = r.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("@", " (dot) "), ("@", ".")])
        out.append(f"write to {name}{at}{site}{dot}{r.choice(['com', 'org', 'de'])} about it")
        out.append(f"write to {name}{at}{site}{dot}{r.choice(['com', 'org', 'de'])}. {r.choice(['Please', 'Then', 'We'])} do so")
        out.append(r.choice([f"mail {name}@{site}. {site.title()} is old", f"sold {i} @ {d(2)} . {d(2)} each", f"{name}@{site} . The end"]))
        phone = r.choice(["({}) {}-{}", "{}-{}-{}", "{} {} {}", "0{}/{}{}", "{}.{}.{}"]).format(d(3), d(3), d(4))
        cue = r.choice(["call", "tel:", "phone", "my mobile is", "fax no.", "contact"])
        out.append(f"{cue} {phone} today")
        out.append(f"{r.choice(['order', 'pages', 'sum', 'part no', 'version', 'invoice'])} {phone} today")
        ssn = f"{r.randrange(100, 660)}-{r.randrange(10, 100)}-{r.randrange(1000, 10000)}"
        out.append(f"{r.choice(['SSN', 'ssn:', 'social security number'])} {ssn} on file")
        out.append(f"{r.choice(['order', 'part', 'id', 'lot'])} {ssn} on file")
        out.append(f"{cue} {r.choice(['12.05.2019', '2020-11-03', '10.0.0.255', '1999/12/31'])} then")
        for _ in range(3):
            word = lambda: r.choice(["host", "from", "ping", "server", "device", "see", "at", "the"])
            group = lambda: hexa()[: r.randrange(1, 5)] if r.random() < 0.6 else d(r.randrange(1, 5))
            m = r.randrange(2, 7)
            short = [group() for _ in range(m)]
            gap = r.randrange(1, m)
            out.append(f"{word()} " + r.choice([":".join(group() for _ in range(8)), f"{':'.join(short[:gap])}::{':'.join(short[gap:])}"]) + " is up")
            twice = f"{group()}::{group()}::{group()}"
            out.append(f"{word()} " + r.choice([":".join(f"{r.randrange(256):02x}" for _ in range(6)), ":".join(d(2) for _ in range(4)), ":".join(group() for _ in range(r.randrange(4, 8))), twice, "::1", "cafe::bead", "add::face:bed"]) + " is up")
        bank, account = r.choice(["DE", "FR", "GB"]), d(18)
        check = 98 - int(account + "".join(str(int(c, 36)) for c in bank) + "00") % 97
        out.append(f"iban {bank}{check:02d}{account} please")
        out.append(f"code {bank}{(check + 1 + r.randrange(90)) % 100:02d}{account} please")
        card = d(15)
        out.append(f"card {card}{next(c for c in '0123456789' if luhn(card + c))} or serial {card}{next(c for c in '0123456789' if not luhn(card + c))} here")
    return out


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    start, kind, end = span
    s = text[start:end]
    digits = "".join(c for c in s if c in "0123456789")
    groups = [g for g in re.split(r"[^0-9]+", s) if g]
    before = text[max(0, start - 24) : start].lower()
    after = text[end : end + 12]
    cue = [before.rfind(w) for w in _CUES]
    place = max(cue)
    prev, nxt = before[-1:], after[:1]
    parts, marks = s.split(":"), s.count("[") + s.count("(") if kind == 4 else 0
    return [
        float(kind == 4), float(kind == 5), float(kind == 6), float(kind == 7),
        len(s), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        s.count("-"), s.count("."), s.count(" "), s.count("(") + s.count(")"), s.count("/"), float(s[:1] == "+" or prev == "+"), float("@" in s),
        float(12 <= len(digits) <= 19 and luhn(digits)), float(kind == 6 and _iban(s)), float(len(groups) == 4 and all(map(_small, groups)) and s.count(".") == 3),
        float(9 <= len(digits) <= 15), float(place >= 0), float(cue.index(place) if place >= 0 else -1), float(len(before) - place if place >= 0 else 99),
        float(prev.isalnum()), float(nxt.isalnum()), float(prev in ":=#"), float(prev in "\"'([<"), float(len(set(digits))),
        s.count(":"), s.count("::"), min(map(len, parts)), max(map(len, parts)), marks, len(_BLANK.findall(s)), float(s.rpartition(".")[2].isalpha()), float(kind == 5 and _SSN.fullmatch(s) is not None), float(_SSN_CUE.search(before) is not None),
        float(kind == 5 and _local_phone(s, groups)), float(_PHONE_CUE.search(before) is not None),
    ]


@dataclass
class PiiModel:
    """Trees, calibration and one threshold per generator kind (above 1: nothing is accepted)."""

    trees: BoostedTrees = field(default_factory=lambda: BoostedTrees(rare=True))
    slope: float = 1.0
    offset: float = 0.0
    thresholds: dict[int, float] = field(default_factory=dict)

    def accept(self, text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        if not spans or not self.thresholds:
            return []
        p = sigmoid(self.slope * self.trees.margin(np.array([features(text, s) for s in spans])) + self.offset)
        return [s for s, q in zip(spans, p, strict=True) if q >= self.thresholds.get(s[1], 2.0)]


def _labelled(doc: object, text: str) -> list[tuple[str, int, int, list[float]]]:
    return [(hashlib.blake2b(f"{doc}:{c}".encode(), digest_size=7).hexdigest(), c[1], int(evident(text, c)), features(text, c)) for c in candidates(text)]


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [row for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for row in _labelled(doc, text)]
        h, k, y, x = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.string()), pa.array(k, pa.int32()), pa.array(y, pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["h", "kind", "label", "x"])


def sample_by_id(docs: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` documents, picked by a hash of the id: the same ones at every run."""
    total = max(1, docs.count())
    share = min(1.0, rows / total)
    return docs.where(F.crc32(F.concat(F.lit("sample:"), F.col("doc_id").cast("string")).cast("binary")) < int(share * (1 << 32)) + 1)


def fit(docs: DataFrame, sample_docs: int = 4000, sample_candidates: int = 20_000, precision: float = 0.95) -> PiiModel:
    """Model from constructed examples and at most ``sample_candidates`` candidates, in equal
    shares for the generators, of about ``sample_docs`` documents."""
    rows = sample_by_id(docs, sample_docs).transform(in_arrow, _training_rows, "h string, kind int, label int, x array<double>")
    place = F.row_number().over(Window.partitionBy("kind").orderBy("h", "label"))
    drawn = rows.withColumn("place", place).where(F.col("place") <= sample_candidates // 4).drop("place").toPandas()
    own = pd.DataFrame([row for i, text in enumerate(_examples()) for row in _labelled(f"example {i}", text)], columns=["h", "kind", "label", "x"])
    data = pd.concat([drawn, own], ignore_index=True).sort_values(["h", "kind", "label"], kind="stable")
    model = PiiModel()
    X, y, kind = np.array(data["x"].tolist()), data["label"].to_numpy(), data["kind"].to_numpy()
    held = np.arange(len(y)) % 2 == 1
    model.trees.fit(X[~held], y[~held])
    margin = model.trees.margin(X[held])
    model.slope, model.offset = platt(margin, y[held])
    p = sigmoid(model.slope * margin + model.offset)
    for k in sorted(set(kind[held].tolist())):
        order = np.argsort(-p[(kind[held] == k)], kind="stable")
        q, t = p[kind[held] == k][order], y[held][kind[held] == k][order]
        good = np.flatnonzero(np.cumsum(t) / np.arange(1, len(t) + 1) >= precision)
        if len(good) and t.sum():
            model.thresholds[int(k)] = max(0.5, float(q[good[-1]]))
    return model


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _scan(model: PiiModel):
    @worker("pii")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                kept, _ = base_spans(text)
                same = {(s, e) for s, _, e in kept}
                more = model.accept(text, [c for c in candidates(text) if (c[0], c[2]) not in same])
                n = [sum(k == j for _, k, _ in kept) for j in range(4)]
                out.append((doc, *n, hashlib.sha256(written(kept).encode()).hexdigest(), written(kept + more), len(more), len(kept) + len(more)))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=_COLUMNS).astype({"doc_id": "Int64"}), schema=_SCHEMA, preserve_index=False)

    return run


_COLUMNS = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_more", "n_found"]
_SCHEMA = pa.schema([(c, pa.string() if c in ("base_sha256", "spans") else pa.int64()) for c in _COLUMNS])


def find_pii(docs: DataFrame, model: PiiModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in whole texts (code points, end exclusive).

    Returns one row per input row: doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans, n_more (spans beyond the base), n_found (all spans).  Null and empty texts have no spans; repeated rows get
    equal results; a null id is carried along; an empty table gives no rows.  With
    ``model`` None one is fitted on a bounded sample of ``docs``.  Columns besides
    the two named are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = model or fit(base)
    return base.transform(in_arrow, _scan(model), ", ".join(f"{c} {'string' if c in ('base_sha256', 'spans') else 'long'}" for c in _COLUMNS))


def redact(text: str, spans: str, mask: str = "[{}]") -> str:
    """``text`` with written spans masked; of overlapping ones the first start wins."""
    out, at = [], 0
    for part in filter(None, spans.split(",")):
        kind, start, end = part.split(":")
        if int(start) >= at:
            out += [text[at : int(start)], mask.format(kind)]
            at = int(end)
    return "".join([*out, text[at:]])
