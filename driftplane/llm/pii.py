"""Personal data: base patterns, and a BiLSTM-CRF tagger that adds what they miss.

Base spans are exact patterns for e-mail addresses, IP addresses, payment cards and phone
numbers.  The tagger reads windows of ``WINDOW`` characters every ``STRIDE``.  A tagged span
that a window cuts is joined with its rest in the next window, which is decoded for it if it
was not yet: spans have no greatest length.  Candidates of all windows of a document are
reconciled at once: of overlapping ones the set of highest total score is chosen by dynamic
programming.  Added spans pass the plain checks of their kind (lengths, Luhn, part sizes)
and never touch a base span.

No span passes its check without a digit, an at sign, or the word "at" in any case and
brackets with a full stop or "dot" no more than ``HOST`` characters behind it (a part of a
host name has at most 63); windows without are only run to follow a span, and running them
all gives the same spans.

The tagger is trained in numpy from labelled spans (:func:`examples`, generated from a
seed, or any labelled texts), once in a process, on windows cut at random places.

Edge cases: null and empty texts have no spans; very long texts are read whole; repeated
rows each get their row; an empty table gives an empty result; other columns, whatever their
names, are ignored (and kept by the stage); offsets are code points, ends exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from . import text as tx
from .tagger import Tagger

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, HOST = 128, 64, 72
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a run of digits never starts inside another: what fails at a run's start fails within it
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = re.compile(r"(?i)\bat\b")
_DOT = re.compile(r"(?i)\bdot\b|\.")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(t: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, in order of kind and start."""
    out: list[Span] = []
    pos, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > pos and t[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            pos = m.end()
        at = t.find("@", m.end() if m else at + 1)
    for m in _IP.finditer(t):
        if all(map(_small, m[0].split("."))):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(t):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


# --- the tagger ---------------------------------------------------------------------------

_MARKS = ".@-_+()[]{}<>:/,;\n %'\"&#=*!?|"


@functools.cache
def symbols() -> np.ndarray:
    """Class of each code point: 0 padding, letters by value without case, digits alike,
    some marks each, other letters, anything else."""
    t = np.full(0x110000, 29 + len(_MARKS), np.uint8)
    t[(tx.letter_table() & 3) > 0] = 28
    for i in range(26):
        t[97 + i] = t[65 + i] = 1 + i
    t[48:58] = 27
    for i, c in enumerate(_MARKS):
        t[ord(c)] = 29 + i
    return t


N_SYMBOLS = 30 + len(_MARKS)


def examples(n: int, seed: int = 0, length: int = WINDOW) -> list[tuple[str, list[Span]]]:
    """Labelled texts: made-up prose with personal data of each kind in usual and disguised
    forms, and numbers that are none."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    num = lambda k: "".join(map(str, r.integers(0, 10, k)))
    parts = "an en er ti on th re st in le de la ou ch ei au ver ung que mi co da so na".split()
    letters = "abcdefghijklmnopqrstuvwxyzéüñß"

    def word() -> str:
        w = "".join(pick(parts) for _ in range(int(r.integers(1, 5)))) if r.random() < 0.8 else "".join(pick(letters) for _ in range(int(r.integers(1, 9))))
        return w.capitalize() if r.random() < 0.1 else w

    def plain() -> str:
        return word().lower().encode("ascii", "ignore").decode() or "x1"

    def name() -> str:
        return pick([plain() + "." + num(2), plain() + pick("._-") + plain(), plain() + num(int(r.integers(0, 4))), plain(), pick(letters[:26]) + plain(), plain() + "+" + plain(), ".".join(plain() for _ in range(int(r.integers(2, 6))))])

    def host() -> str:
        part = lambda: pick([plain(), plain() + plain(), plain() + "-" + plain(), plain() + num(int(r.integers(1, 3)))])
        return ".".join(part() for _ in range(pick([1, 1, 1, 2, 2, 3, 4])))

    def email() -> str:
        at = pick(["@"] * 5 + [" @ ", " at ", " at ", " at ", " (at) ", " [at] ", "(at)", "[at]", " {at} "])
        dot = "." if at == "@" or r.random() < 0.4 else pick([" dot ", " dot ", " (dot) ", "[dot]", "(dot)", " . ", " {dot} "])
        found = name() + at + host().replace(".", dot) + dot + pick(["com", "org", "net", "de", "fr", "es", "io", "info", "co" + dot + "uk", "edu"])
        found = found.upper() if r.random() < 0.1 else found
        return found if len(found) <= length - STRIDE else email()

    def ip() -> str:
        return pick([".", ".", ".", "[.]", "(.)", " . "]).join(str(int(r.integers(0, 256))) for _ in range(4))

    def card() -> str:
        d = num(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return pick(["", "", " ", "-", ".", "/"]).join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick([f"+1 ({a}) {b}-{c}", f"+{num(2)} {num(2)} {num(4)} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{num(2)} {num(2)} {num(4)} {c}", f"{a}.{b}.{c}", f"+{num(2)}/{num(3)}/{num(6)}"])

    def other() -> str:
        return pick([num(4), num(2), f"{num(2)}.{num(2)}.{num(4)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}", f"${num(3)}.{num(2)}", f"v{num(1)}.{num(1)}.{num(2)}", "#" + num(5), num(7), f"{num(1)},{num(3)},{num(3)}", "@" + word(), word() + num(3), f"{num(3)} at {num(2)}", "at " + word() + " dot " + word(), word() + " at " + word() + ". " + word().capitalize(), word() + " at the " + word(), f"{num(2)} | {num(2)} | {num(3)}", "".join(pick("0123456789abcdef") for _ in range(20)), f"+1 ({num(3)})"])

    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < length:
            x = r.random()
            if x < 0.12:
                k = int(r.integers(4))
                s = (email, ip, card, phone)[k]()
                if len(text) + len(s) <= length:
                    spans.append((k, len(text), len(text) + len(s)))
                    text += s
            elif x < 0.18:
                text += other()
            else:
                text += word()
            text += pick([" "] * 12 + [", ", ". ", ".\n", " | ", "&&& ", ": ", "\n"])
        out.append((text[:length], spans))
    return out


def encode(rows: list[tuple[str, list[Span]]], starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, mask and tags of a window of each text, from 0 or the place given."""
    x, y = np.zeros((len(rows), WINDOW), np.uint8), np.zeros((len(rows), WINDOW), np.int64)
    for i, (text, spans) in enumerate(rows):
        lo = 0 if starts is None else int(starts[i])
        cp = np.frombuffer(text[lo : lo + WINDOW].encode("utf-32-le", "surrogatepass"), "<u4")
        x[i, : len(cp)] = symbols()[cp]
        for k, s, e in spans:
            if e > lo and s < lo + WINDOW:
                y[i, max(s - lo, 0) : e - lo] = 2 + 2 * k
                if s >= lo:
                    y[i, s - lo] = 1 + 2 * k
    return x, (x > 0).astype(np.float32), y


def fit(rows: list[tuple[str, list[Span]]], *, epochs: int = 7, seed: int = 0) -> Tagger:
    tagger = Tagger.fresh(N_SYMBOLS, TAGS, seed=seed)
    room = np.maximum(0, [len(t) - WINDOW for t, _ in rows])
    tagger.train(*encode(rows, np.random.default_rng(seed).integers(0, room + 1)), epochs=epochs, seed=seed)
    return tagger


@functools.cache
def default_tagger(n: int = 3200, epochs: int = 8, seed: int = 0) -> Tagger:
    return fit(examples(n, seed, WINDOW + STRIDE), epochs=epochs, seed=seed)


def _valid(kind: int, s: str) -> bool:
    """The plain check of a kind on what the tagger found."""
    d = _digits(s)
    if kind == 0:
        return "@" in s and "." in s[s.index("@") :] or any(_DOT.search(s, m.end(), m.end() + HOST) for m in _AT.finditer(s))
    if kind == 1:
        found = re.findall(r"[0-9]+", s)
        return len(found) == 4 and all(map(_small, found))
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 and not any(c.isalpha() for c in s)


def _whole(kind: int, t: str, s: int, e: int) -> bool:
    """Whether the "at" of a spelled-out address is a word of the text, not a part of one cut
    by the span."""
    return kind > 0 or "@" in t[s:e] or any(s <= m.start() and m.end() <= e for m in _AT.finditer(t, s, e + 1))


_HOST = re.compile(r"(?i)[\s)\]}>]{0,4}[a-z0-9-]+(?:(?:\.|\s{1,4}\.\s{1,4}|\s{0,4}[(\[{]\s{0,2}(?:dot|\.)\s{0,2}[)\]}]\s{0,4}|\s{1,4}dot\s{1,4})[a-z0-9-]+)+")
_MARK = re.compile(r"(?i)@|\bat\b")


def _address(t: str, s: int, e: int) -> tuple[int, int]:
    """Where a spelled-out address begins and ends within the span: about the last mark that
    a host follows, from the last white space before it to the host's last part."""
    for m in reversed(list(_MARK.finditer(t, s, e))):
        host = _HOST.match(t, m.end(), e)
        before = t[s : m.start()].rstrip(" \t\n([{<")
        if host and before:
            return s + max(before.rfind(c) for c in " \t\n") + 1, host.end()
    return s, e


def choose(found: list[tuple[float, Span]]) -> list[Span]:
    """Of weighted spans, the non-overlapping ones of highest total score (all kinds)."""
    found = sorted(set(found), key=lambda x: (x[1][2], x[1][1], x[1][0]))
    ends = [f[1][2] for f in found]
    best: list[tuple[float, int]] = [(0.0, -1)]
    for i, (w, (_, s, _)) in enumerate(found):
        j = bisect_right(ends, s, 0, i)
        best.append(max(best[-1], (best[j][0] + w, i), key=lambda x: x[0]))
    out, i = [], len(found)
    while i > 0:
        if best[i][1] == i - 1:
            out.append(found[i - 1][1])
            i = bisect_right(ends, found[i - 1][1][1], 0, i - 1)
        else:
            i -= 1
    return out[::-1]


def _windows(b: tx.Block) -> tuple[np.ndarray, np.ndarray]:
    """(document, number) of the windows that hold what :func:`_valid` asks for."""
    cp, small = b.cp, b.cp | np.uint32(32)
    digit = (cp - np.uint32(48)) < 10
    at = np.flatnonzero(digit | (cp == 64))
    # the word "at"; letters beyond ASCII beside it do not count here, which only adds windows
    word = ((small - np.uint32(97)) < 26) | digit | (cp == 95)
    a = np.flatnonzero((small[:-1] == 97) & (small[1:] == 116))
    before = (a > b.start[b.doc(a)]) & word[a - 1]
    after = (a + 2 < b.end[b.doc(a)]) & word[np.minimum(a + 2, len(cp) - 1)]
    a = a[~before & ~after]
    dot = cp == 46
    if len(cp) > 2:
        dot[:-2] |= (small[:-2] == 100) & (small[1:-1] == 111) & (small[2:] == 116)
    dots = np.concatenate(([0], np.cumsum(dot)))
    a = a[dots[np.minimum(a + 2 + HOST, b.end[b.doc(a)])] > dots[a]]
    at = np.concatenate((at, a))
    doc = b.doc(at)
    k = (at - b.start[doc]) // STRIDE
    key = np.unique(np.concatenate((doc, doc[k > 0])) << np.int64(40) | np.concatenate((k, k[k > 0] - 1)))
    return key >> np.int64(40), key & ((np.int64(1) << np.int64(40)) - 1)


#: kind, start, end, score, whether the window cuts it on the left, on the right
Segment = tuple[int, int, int, float, bool, bool]


def _decode(b: tx.Block, code: np.ndarray, doc: np.ndarray, k: np.ndarray, tagger: Tagger, batch: int) -> dict[tuple[int, int], list[Segment]]:
    """Tagged segments of the windows, by (document, number)."""
    out: dict[tuple[int, int], list[Segment]] = {}
    for lo in range(0, len(doc), batch):
        d, n = doc[lo : lo + batch], k[lo : lo + batch] * STRIDE
        at = (b.start[d] + n)[:, None] + np.arange(WINDOW)
        on = at < b.end[d][:, None]
        x = np.where(on, code[np.minimum(at, len(code) - 1)], 0)
        tags, score = tagger.decode(np.ascontiguousarray(x.T), np.ascontiguousarray(on.T.astype(np.float32)))
        for w in np.flatnonzero((tags > 0).any(0)).tolist():
            row, points, offset, i = tags[:, w], score[:, w], int(n[w]), int(d[w])
            length, found = int(b.chars[i]), []
            for s in np.flatnonzero((row % 2 == 1) | ((row > 0) & (np.arange(WINDOW) == 0))).tolist():
                kind, e = int(row[s] - 1) // 2, s + 1
                while e < WINDOW and row[e] == 2 + 2 * kind:
                    e += 1
                found.append((kind, offset + s, offset + e, float(points[s:e].sum()), s == 0 and offset > 0, e == WINDOW and offset + e < length))
            out[i, offset // STRIDE] = found
    return out


def _joined(segments: dict[tuple[int, int], list[Segment]], n: int) -> list[list[tuple[float, Span]]]:
    """Scored spans of each document: whole ones, and cut ones joined across windows."""
    found: list[list[tuple[float, Span]]] = [[] for _ in range(n)]
    last, open_ = (-1, -1), None
    for at in sorted(segments):
        before = open_ if at == (last[0], last[1] + 1) else None
        last, open_ = at, None
        for kind, s, e, w, left, right in segments[at]:
            if left:
                if before is None or before[0] != kind:
                    continue
                s, w = before[1], before[2] + w
            if right:
                open_ = (kind, s, w)
            else:
                found[at[0]].append((round(w, 3), (kind, s, e)))
    return found


def find(texts: list[str], tagger: Tagger, batch: int = 128) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans and added spans of each text."""
    b = tx.Block(texts)
    has = np.concatenate(([0], np.cumsum(((b.cp - np.uint32(48)) < 10) | (b.cp == 64))))
    some = has[b.end] > has[b.start]
    base = [base_spans(t) if some[i] else [] for i, t in enumerate(texts)]
    doc, k = _windows(b)
    code, segments = symbols()[b.cp], {}
    done = set(zip(doc.tolist(), k.tolist(), strict=True))
    while len(doc):
        new = _decode(b, code, doc, k, tagger, batch)
        segments |= new
        # where a window cuts a span, its neighbour is decoded too
        more = {(i, j + step) for (i, j), found in new.items() for x in found for step, cut in ((-1, x[4]), (1, x[5])) if cut} - done
        done |= more
        doc, k = np.array(sorted(more), np.int64).reshape(-1, 2).T
    added: list[list[Span]] = []
    for t, old, new in zip(texts, base, _joined(segments, len(texts)), strict=True):
        keep = []
        for w, (kind, s, e) in new:
            while s < e and t[s] in " \n\t,.;:|&([{" and not (kind == 3 and t[s] == "("):
                s += 1
            while e > s and t[e - 1] in " \n\t,.;:|&)]}":
                e -= 1
            if kind == 0:
                s, e = _address(t, s, e)
            if w > 0 and s < e and _valid(kind, t[s:e]) and _whole(kind, t, s, e) and not any(s < oe and os < e for _, os, oe in old):
                keep.append((w, (kind, s, e)))
        added.append(choose(keep))
    return base, added


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """(id, base, added): arrays of spans (kind, start, end) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger or default_tagger())
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        as_rows = lambda found: pa.array([[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in sorted(x)] for x in found], pa.list_(span))
        for batch in batches:
            for lo, hi in tx.slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                base, added = find(tx.texts_of(part.column(1)), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), as_rows(base), as_rows(added)], names=[id_col, "base", "added"])

    spans = "array<struct<kind: string, start: long, end: long>>"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, base {spans}, added {spans}")


def _listed(spans) -> F.Column:
    """kind:start:end by kind as listed, then start."""
    order = F.transform(spans, lambda x: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("k"), x["start"].alias("s"), x["end"].alias("e"), x["kind"].alias("n")))
    return F.array_join(F.transform(F.array_sort(order), lambda x: F.concat_ws(":", x["n"], x["s"], x["e"])), ",")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(store.table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redact(t: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one mark."""
    out, pos = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= pos:
            out += [t[pos:s], f"[{KINDS[k].upper()}]"]
        pos = max(pos, e)
    return "".join(out) + t[pos:]


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; every document stays."""
    store.bound_batches(spark)
    shared, schema = spark.sparkContext.broadcast(default_tagger()), docs.schema
    at = schema.names.index("text")
    count = schema.names.index("n_chars") if "n_chars" in schema.names else -1

    def run(batches):
        for batch in batches:
            for lo, hi in tx.slices(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                texts = tx.texts_of(part.column(at))
                base, added = find(texts, shared.value)
                nulls = part.column(at).is_null().to_pylist()
                new = [None if z else redact(t, [*x, *y]) if x or y else t for t, x, y, z in zip(texts, base, added, nulls, strict=True)]
                columns = list(part.columns)
                columns[at] = pa.array(new, part.schema.field(at).type)
                if count >= 0:
                    old = columns[count].to_pylist()
                    columns[count] = pa.array([n if t is None or not (x or y) else len(t) for n, t, x, y in zip(old, new, base, added, strict=True)], part.schema.field(count).type)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(run, schema)
