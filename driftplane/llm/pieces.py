"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text becomes symbols, one a character.  An agenda holds every adjacent pair whose joint is
a piece, best score first and leftmost among equals; taking the head joins its two symbols
and puts the new neighbours on the agenda, until it is empty.  Characters without a piece
become byte pieces.

No join crosses two neighbouring characters that are neighbours in no piece of the
vocabulary, so the text is cut there first, for whole blocks at once, and each distinct run
goes through the agenda once a task (a cache of bounded size; long runs keep
their agenda in a heap, those of many short runs are worked off together in numpy).
Every Arrow batch is then encoded by the sentencepiece library too, and a row that differs
ends the job: results are never silently others than the library's.

The vocabulary is read from the model file; what the method does not cover is refused with
an error: models that are no BPE, user-defined or unused pieces, character maps, trimmed
spaces, no byte fallback.

Edge cases: null counts as empty; the empty text has the end id only; very long texts and
runs are encoded whole (the agenda takes n log n steps); repeated rows each get their row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from . import text as tx

#: The sign that stands for a space in pieces (a fixed value of the file format).
SPACE = "▁"
#: Runs and ids in a task's cache, beyond which it is emptied, and the longest run whose agenda
#: is worked off together with those of others.
CACHE_RUNS, CACHE_IDS, SHORT = 400_000, 4_000_000, 64
#: Bytes of text that are encoded together: runs that repeat in them are looked up once.
SLICE = 1 << 20
#: The place of a pair that is no piece.
NONE = 1 << 30
#: Kinds of pieces in the file format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind == 2:
            size, at = _varint(raw, at)
            value, at = raw[at : at + size], at + size
        elif kind == 5:
            value, at = struct.unpack_from("<f", raw, at)[0], at + 4
        else:
            value, at = raw[at : at + 8], at + 8
        yield key >> 3, value


class Codec:
    """Encoder and decoder of one model file, given as bytes."""

    def __init__(self, model: bytes):
        rows, trainer, normal = [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                rows.append(dict(_fields(value)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        names = [r.get(1, b"").decode() for r in rows]
        kinds = [r.get(3, NORMAL) for r in rows]
        if trainer.get(3, 1) != 2:
            raise ValueError("not a merge-type vocabulary")
        if {USER, UNUSED} & set(kinds):
            raise ValueError("user-defined or unused pieces are not covered")
        if not trainer.get(35, 0) or kinds.count(BYTE) != 256:
            raise ValueError("the vocabulary has no byte pieces to fall back on")
        if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24, 0):
            raise ValueError("texts are normalised in a way that is not covered")
        self.lead = bool(normal.get(3, 1))
        self.end = trainer.get(42, 2)
        self.ids = {n: i for i, (n, k) in enumerate(zip(names, kinds, strict=True)) if k == NORMAL}
        # place of each piece in the order of scores: what the agenda compares
        score = {i: rows[i].get(2, 0.0) for i in self.ids.values()}
        place = {s: p for p, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.order = {n: place[score[i]] for n, i in self.ids.items()}
        self.bytes = [0] * 256
        for i, (n, k) in enumerate(zip(names, kinds, strict=True)):
            if k == BYTE:
                self.bytes[int(n[3:5], 16)] = i
        self.to_byte = {i: bytes([b]) for b, i in enumerate(self.bytes)}
        #: text of each id; control pieces have none, the unknown one its sign
        self.shown = [n.replace(SPACE, " ") if k == NORMAL else " ⁇ " if k == UNKNOWN else "" for n, k in zip(names, kinds, strict=True)]
        self.texts = pa.array(self.shown, pa.string())
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.is_text = np.array([k in (NORMAL, UNKNOWN) for k in kinds])
        self.is_spaced = np.array([k == NORMAL and n.startswith(SPACE) for n, k in zip(names, kinds, strict=True)])
        self.spaced = {i for n, i in self.ids.items() if n.startswith(SPACE)}
        # characters of pieces, numbered from 1, and which of them are neighbours in a piece
        chars = sorted({c for n in self.ids for c in n})
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        near = {(a, b) for n in self.ids for a, b in zip(n, n[1:], strict=False)}
        self.near = np.zeros(self.width * self.width, bool)
        if near:
            left, right = (self.number[[ord(p[i]) for p in near]].astype(np.int64) for i in (0, 1))
            self.near[left * self.width + right] = True
        # every way to make a piece of two: the pair, its place and its joint
        self.size = len(names)
        self.char_id = np.full(0x110000, -1, np.int64)
        self.char_id[[ord(c) for c in chars]] = [self.ids.get(c, -1) for c in chars]
        made = {(self.ids[n[:k]], self.ids[n[k:]]): n for n in self.ids for k in range(1, len(n)) if n[:k] in self.ids and n[k:] in self.ids}
        keys = np.array([a * self.size + b for a, b in made], np.int64)
        by = np.argsort(keys)
        self.pairs = keys[by]
        self.pair_place = np.append(np.array([self.order[n] for n in made.values()], np.int64)[by], NONE)
        self.pair_joint = np.append(np.array([self.ids[n] for n in made.values()], np.int64)[by], -1)
        self._forget()

    def merge(self, run: str) -> tuple[int, ...]:
        """Ids of one run; its agenda is a heap of (place, start, end) of symbol pairs."""
        n, order = len(run), self.order
        after = list(range(1, n + 1))  # start of the symbol behind the one that starts here
        before = list(range(-1, n - 1))
        agenda: list[tuple[int, int, int]] = []

        def offer(a: int, end: int) -> None:
            if (at := order.get(run[a:end])) is not None:
                heapq.heappush(agenda, (at, a, end))

        for a in range(n - 1):
            offer(a, a + 2)
        while agenda:
            _, a, end = heapq.heappop(agenda)
            b = after[a]
            # out of date, if either symbol has grown or gone
            if b < 0 or b >= n or after[b] != end:
                continue
            after[a], after[b] = end, -1
            if end < n:
                before[end] = a
                offer(a, after[end])
            if before[a] >= 0:
                offer(before[a], end)
        out, a = [], 0
        while a < n:
            symbol = run[a : after[a]]
            known = self.ids.get(symbol)
            out += [known] if known is not None else [self.bytes[x] for x in symbol.encode()]
            a = after[a]
        return tuple(out)

    def _offers(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the order of scores and joint piece of symbol pairs; NONE without a joint."""
        at = tx.member(self.pairs, left.astype(np.int64) * self.size + right)
        on = (at >= 0) & (left >= 0) & (right >= 0)
        return np.where(on, self.pair_place[at], NONE), self.pair_joint[at]

    def merge_all(self, cp: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`merge` of many short runs at once: their code points in a row and lengths; ids in
        a row and their numbers.  Each step takes the head of every run's agenda: the pair of
        the best place, the leftmost of equals."""
        run = np.repeat(np.arange(len(lens)), lens)
        symbol = self.char_id[cp]
        place = np.full(len(cp), NONE)
        joint = np.zeros(len(cp), np.int64)
        if len(cp) > 1:
            place[:-1], joint[:-1] = self._offers(symbol[:-1], symbol[1:])
            place[:-1][run[1:] != run[:-1]] = NONE
        done = [(run[:0], symbol[:0], cp[:0])]
        while len(run):
            first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
            head = np.minimum.reduceat((place << 32) | np.arange(len(run)), first)
            go = (head >> 32) < NONE
            keep = np.repeat(go, np.diff(np.append(first, len(run))))
            done.append((run[~keep], symbol[~keep], cp[~keep]))
            at = head[go] & 0xFFFFFFFF
            symbol[at] = joint[at]
            keep[at + 1] = False
            # where the joined symbols come to stand
            at = np.cumsum(keep)[at] - 1
            run, symbol, cp, place, joint = (x[keep] for x in (run, symbol, cp, place, joint))
            for w in (at, at[at > 0] - 1):
                place[w] = NONE
                w = w[w < len(run) - 1]
                w = w[run[w] == run[w + 1]]
                place[w], joint[w] = self._offers(symbol[w], symbol[w + 1])
        run, symbol, cp = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(run, kind="stable")
        run, symbol, cp = run[order], symbol[order], cp[order]
        odd = np.flatnonzero(symbol < 0)
        if len(odd):  # characters without a piece: their bytes
            each = [[self.bytes[b] for b in chr(c).encode()] for c in cp[odd].tolist()]
            times = np.ones(len(symbol), np.int64)
            times[odd] = [len(x) for x in each]
            unknown = np.repeat(symbol < 0, times)
            run, symbol = np.repeat(run, times), np.repeat(symbol, times)
            symbol[unknown] = list(chain.from_iterable(each))
        return symbol.astype(np.int32), np.bincount(run, minlength=len(lens))

    def _forget(self) -> None:
        """Empties the cache: sorted hashes of runs, and where in ``pool`` each one's ids are."""
        self.keys, self.from_, self.number_of = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        """Puts the runs of code points from s to e through the agenda and into the cache."""
        lens = e - s
        short = lens <= SHORT
        n = lens[short]
        at = np.repeat(s[short] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        flat, sizes = self.merge_all(cp[at], n)
        long = [self.merge(cp[i:j].tobytes().decode("utf-32-le")) for i, j in zip(s[~short].tolist(), e[~short].tolist(), strict=True)]
        flat = np.concatenate([flat, np.fromiter(chain.from_iterable(long), np.int32)])
        sizes = np.concatenate([sizes, np.array([len(x) for x in long], np.int64)])
        keys = np.concatenate([self.keys, keys[short], keys[~short]])
        from_ = np.concatenate([self.from_, len(self.pool) + np.cumsum(sizes) - sizes])
        by = np.argsort(keys)
        self.keys, self.from_, self.number_of = keys[by], from_[by], np.concatenate([self.number_of, sizes])[by]
        self.pool = np.concatenate([self.pool, flat])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of each text's), the end id last in each."""
        lead = SPACE if self.lead else ""
        b = tx.Block([lead + t.replace(" ", SPACE) if t else "" for t in texts])
        at = self.number[b.cp].astype(np.int64)
        cut = np.ones(len(b.cp), bool)
        cut[1:] = ~self.near[at[:-1] * self.width + at[1:]]
        cut[b.start] = cut[b.end] = True
        s = np.flatnonzero(cut)
        e = np.append(s[1:], len(b.cp))
        texted = np.ones(len(b.cp), bool)
        texted[b.end] = False
        s, e = s[texted[s]], e[texted[s]]
        # different runs once, by a hash; the library's ids are the proof
        keys, first, which = np.unique(tx.Hasher(b.cp).spans(s, e), return_index=True, return_inverse=True)
        new = tx.member(self.keys, keys) < 0
        if len(self.keys) + new.sum() > CACHE_RUNS or len(self.pool) > CACHE_IDS:
            self._forget()
            new[:] = True
        if new.any():
            self._learn(keys[new], b.cp, s[first[new]], e[first[new]])
        of = tx.member(self.keys, keys)[which]
        n = self.number_of[of]
        total = int(n.sum())
        doc = np.repeat(b.doc(s), n)
        out = np.full(total + b.n, self.end, np.int32)
        out[np.arange(total) + doc] = self.pool[np.repeat(self.from_[of] - np.cumsum(n) + n, n) + np.arange(total)]
        return out, np.bincount(doc, minlength=b.n) + 1

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces in a row are UTF-8, what is no UTF-8 becomes U+FFFD, and
        the space that encoding puts first goes."""
        shown, to_byte = self.shown, self.to_byte
        if to_byte.keys().isdisjoint(ids):
            text = "".join([shown[i] for i in ids])
        else:
            out, held = [], b""
            for i in ids:
                if i in to_byte:
                    held += to_byte[i]
                else:
                    if held:
                        out.append(_utf8(held))
                        held = b""
                    out.append(shown[i])
            text = "".join([*out, _utf8(held)])
        return self._bare(ids, text)

    def decode_all(self, ids: list[list[int]], flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """:meth:`decode` of many rows, given as lists and in a row: rows without byte pieces that
        begin with a piece of text are joined at once."""
        upto = np.concatenate(([0], np.cumsum(sizes)))
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), self.texts.take(pa.array(flat))), "")
        first = np.append(flat, self.end)[upto[:-1]]
        if self.lead:
            text = pc.if_else(pa.array(self.is_spaced[first] & (sizes > 0)), pc.utf8_slice_codeunits(text, 1), text)
        odd = (sizes > 0) & ~self.is_text[first]
        odd[np.repeat(np.arange(len(ids)), sizes)[self.is_byte[flat]]] = True
        if odd.any():
            rows = text.to_pylist()
            for i in np.flatnonzero(odd).tolist():
                rows[i] = self.decode(ids[i])
            text = pa.array(rows, pa.string())
        return text

    def _bare(self, ids: list[int], text: str) -> str:
        first = next((i for i in ids if i in self.to_byte or self.shown[i]), None)
        return text[1:] if self.lead and first in self.spaced else text


def _utf8(raw: bytes) -> str:
    """Bytes as text; each byte that no character takes is one U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out = []
        while raw:
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[:n].decode())
                    raw = raw[n:]
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                raw = raw[1:]
        return "".join(out)


@functools.lru_cache(maxsize=2)
def _codec(model: bytes) -> Codec:
    return Codec(model)


@functools.lru_cache(maxsize=2)
def _library(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def _differs(what: str, got: list, want: list) -> None:
    if got != want:
        bad = next(i for i, (a, b) in enumerate(zip(got, want, strict=True)) if a != b)
        raise ValueError(f"{what} differs from the library's in row {bad} of a batch: {str(got[bad])[:200]} and {str(want[bad])[:200]}")


def _split(flat: list, sizes: np.ndarray) -> list[list]:
    upto = np.concatenate(([0], np.cumsum(sizes))).tolist()
    return [flat[i:j] for i, j in zip(upto, upto[1:], strict=False)]


def _encoded(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat))


def _model(spark: SparkSession, path: str | None) -> bytes:
    """The model file, read by the driver: vocabularies are small (see MODEL_BYTES)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if "://" in path:
        row = spark.read.format("binaryFile").load(path).select("length", "content")
        if row.first()["length"] > MODEL_BYTES:
            raise ValueError(f"a model of more than {MODEL_BYTES} bytes")
        return bytes(row.first()["content"])
    with open(path, "rb") as f:
        raw = f.read(MODEL_BYTES + 1)
    if len(raw) > MODEL_BYTES:
        raise ValueError(f"a model of more than {MODEL_BYTES} bytes")
    return raw


#: Bytes of a model file that are sent to executors at most.
MODEL_BYTES = 64 << 20


def encode(docs: DataFrame, model: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """(id, ids) of every row: the piece ids of its whole text, the end id last.  ``model`` is
    the path of a model file; ``check`` compares every row with the library."""
    spark = docs.sparkSession
    store.bound_batches(spark)
    raw = spark.sparkContext.broadcast(_model(spark, model))
    _codec(raw.value)  # refuses on the driver what is not covered

    def run(batches):
        codec = _codec(raw.value)
        for batch in batches:
            for lo, hi in tx.slices(batch.column(1), SLICE):
                part = batch.slice(lo, hi - lo)
                texts = tx.texts_of(part.column(1))
                flat, sizes = codec.encode(texts)
                if check:
                    want = _library(raw.value).encode(texts, add_eos=True, num_threads=1)
                    same = np.array_equal(sizes, np.fromiter(map(len, want), np.int64, len(want))) and np.array_equal(flat, np.fromiter(chain.from_iterable(want), np.int32))
                    if not same:
                        _differs("encoding", _split(flat.tolist(), sizes), want)
                yield pa.RecordBatch.from_arrays([part.column(0), _encoded(flat, sizes)], names=["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str | None = None, *, id_col: str = "doc_id", check: bool = True) -> DataFrame:
    """(id, ids, text) of rows (id, ids): the text that the ids stand for.  Null ids count as
    none."""
    spark = encoded.sparkSession
    store.bound_batches(spark)
    raw = spark.sparkContext.broadcast(_model(spark, model))

    def run(batches):
        codec = _codec(raw.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                col = part.column(1)
                flat, sizes = col.flatten().to_numpy(zero_copy_only=False), np.asarray(pc.fill_null(pc.list_value_length(col), 0))
                ids = _split(flat.tolist(), sizes)
                got = codec.decode_all(ids, flat, sizes)
                if check:
                    want = _library(raw.value).decode(ids)
                    if not got.equals(pa.array(want, pa.string())):
                        _differs("decoding", got.to_pylist(), want)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), got], names=["id", "ids", "text"])
            tx.release()

    rows = encoded.select(F.col(id_col).alias("id"), "ids")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, text string").withColumnRenamed("id", id_col)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode(encode(store.table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
