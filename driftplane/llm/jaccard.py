"""N-gram Jaccard join with token-combination prefixes.

Documents are sets of hashed word shingles; equal sets are one *node*.  Two nodes link when
100 * intersection >= 80 * union; a document's component is what links reach.

Signatures.  A node of n shingles may lack at most e = n - ceil(4 (n + m) / 9) of them in a
linked node of m, a fifth of them for any m.  All shingles have one global order: rare
before frequent, then by hash.  A node's prefix is its first e + 1 rare shingles, each a
signature.  If it has no more than e rare ones (r), the prefix extends to all frequent ones,
dealt to 1, 2, 3, 4, 6, ... classes by hash; the combination of all frequent shingles in a
class is a signature.  If two linked nodes share no rare shingle, each lacks at most e - r of its
frequent ones, and every one lacked breaks one class: at the first level where either fills
more classes than both can lack together, one filled class is the same in both.  Signatures
carry what decides whether the pair needs that level.  A shingle is frequent if it occurs in
many hash-ordered prefixes; the label only steers cost, any labelling is exact.  (Where a
prefix holds frequent shingles it extends to others, which a second round counts.)  At most
``max_frequent`` labels are broadcast: the threshold rises until they fit.

Verification.  Comparing all holders of a signature would be quadratic in a family of near
copies.  So first, in ``stars`` rounds, every node is compared with one holder that many
of its signatures elect; verified links are merged into components by a distributed star
algorithm.  Then all pairs that share a signature and are still in different components
are compared, whatever their number.  Links inside a component need no check.  A lower
bound of the difference from parity bitmaps rejects most pairs before sets are compared.

Rows travel as (signature, node); texts are never shuffled.  Shingles and nodes are 64-bit
hashes: among N distinct sets, N * N / 2**65 collisions are expected.

Edge cases: null and empty texts have no shingles and link with nothing; texts of fewer
words than a shingle are one shingle; rows without an id link with nothing and have a null
component; rows that repeat an id count as documents of the same id; very long texts are
shingled whole; holders that tie in an election are told apart by hash; an empty table gives
an empty result; other columns, whatever their names, are ignored (and kept by the stage,
which tells rows apart by id and text).
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from . import text as tx
from .components import components

WORDS = 5
FREQUENT, MAX_FREQUENT = 32, 4_000_000


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle), sorted and distinct, of some texts."""
    b = tx.Block(texts)
    low = tx.ascii_lower(b.cp)
    s, e, doc = b.runs(tx.is_token(low))
    h = tx.Hasher(low).spans(s, e)
    count = np.bincount(doc, minlength=b.n)
    at = tx.firsts(doc, words)
    d, g = [doc[at]], [tx.ngrams(h, words)[at]]
    for n in range(1, words):
        first = np.searchsorted(doc, np.flatnonzero(count == n), "left")
        if len(first):
            d.append(doc[first])
            g.append(tx.ngrams(h, n)[first])
    d, g = np.concatenate(d), np.concatenate(g)
    order = np.lexsort((g, d))
    d, g = d[order], g[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
    return d[new], g[new]


def errors(n: np.ndarray) -> np.ndarray:
    """How many of n shingles a linked set may lack."""
    return n - (4 * n + 4) // 5


def linked(n_a: int, n_b: int, common: int) -> bool:
    return 100 * common >= 80 * (n_a + n_b - common)


class Sets:
    """The shingle sets of a slice of documents, with nodes and parity bitmaps."""

    def __init__(self, texts: list[str], words: int):
        self.d, self.g = shingles(texts, words)
        self.n = np.bincount(self.d, minlength=len(texts))
        self.lo = np.concatenate(([0], np.cumsum(self.n)))
        salted = tx.mix(self.g + np.uint64(0x5851F42D4C957F2D))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(salted)))
        self.node = tx.mix((total[self.lo[1:]] - total[self.lo[:-1]]) + self.n.astype(np.uint64)).view(np.int64)

    def bitmaps(self) -> list[bytes]:
        """Parity bitmaps of 256 to 4096 bits: any two differ by no more than their sets."""
        bits = np.clip(1 << np.ceil(np.log2(np.maximum(2 * self.n, 2))).astype(np.int64), 256, 4096)
        base = np.concatenate(([0], np.cumsum(bits)))
        at = base[self.d] + (self.g & (bits[self.d] - 1).astype(np.uint64)).astype(np.int64)
        packed = np.packbits((np.bincount(at, minlength=base[-1]) & 1).astype(np.uint8)).tobytes()
        return [packed[a // 8 : b // 8] for a, b in zip(base[:-1], base[1:], strict=True)]


def _prefixes(batches, words: int, frequent=None):
    """Shingles of the hash-ordered prefixes; a set counts once a task.  With known frequent
    shingles: those that a prefix extends to for the frequent ones it holds."""
    seen: set[int] = set()
    common = frequent.value if frequent else None
    for batch in batches:
        for lo, hi in tx.slices(batch.column(0)):
            s = Sets(tx.texts_of(batch.column(0).slice(lo, hi - lo)), words)
            rank = np.arange(len(s.d)) - s.lo[s.d]
            first = rank <= errors(s.n)[s.d]
            keep = first
            if frequent:
                hit = tx.member(common, s.g[first]) >= 0
                held, size = np.bincount(s.d[first][hit], minlength=len(s.n)), errors(s.n) + 1
                more = np.ceil(1.25 * held * size / np.maximum(size - held, 0.1))
                keep = ~first & (rank < (size + more)[s.d])
            keep &= _fresh(s, seen)[s.d]
            yield pa.RecordBatch.from_arrays([pa.array(s.g[keep].view(np.int64))], names=["token"])


def _fresh(s: Sets, seen: set[int]) -> np.ndarray:
    """Which sets were not met in this task; those of under 4 shingles link with no other."""
    out = np.zeros(len(s.n), bool)
    for i in np.flatnonzero(s.n >= 4).tolist():
        x = int(s.node[i])
        if x not in seen:
            seen.add(x)
            out[i] = True
    return out


def missing(n: int, m: int) -> int:
    """How many of n shingles a linked set of m may lack; negative if none can link."""
    return n - (4 * (n + m) + 8) // 9


@functools.cache
def levels() -> list[int]:
    """Numbers of classes, each a third to a half above the one before."""
    return sorted({m << k for k in range(30) for m in (1, 3)})


def signatures(g: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of one sorted set that has no more rare shingles than it may lack, and two
    words of info: each rare shingle, and the combination of all frequent shingles of each
    class at levels of 1, 2, 3, 4, 6, 8, ... classes."""
    n, rare, common = len(g), g[~frequent], g[frequent]
    r = len(rare)
    keys, info, more = [rare], [pack(np.arange(r), np.zeros(r, np.int64), 0)], [np.zeros(r, np.int64)]
    total = n + 5 * n // 4  # with the largest partner
    need = total - 2 * ((4 * total + 8) // 9) - r + 2
    salted, part, full = tx.mix(common.copy()), common >> np.uint64(32), 0
    for m in levels():
        if full >= need or not len(common):
            break
        cls = (part * np.uint64(m)) >> np.uint64(32)
        start = np.concatenate(([0], np.flatnonzero(cls[1:] != cls[:-1]) + 1))
        k = np.add.reduceat(salted, start)
        k *= np.uint64(0xD1342543DE82EF95)
        k += cls[start] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(m)
        keys.append(tx.mix(k))
        info.append(pack(np.full(len(k), r), np.full(len(k), full), 1))
        more.append((np.int64(len(k)) << 32) | np.arange(len(k)))
        full = max(full, len(k))
    return np.concatenate(keys), np.concatenate(info), np.concatenate(more)


def pack(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    """kind 0: a is the rank of a rare shingle.  kind 1: a is the number of rare shingles, b
    how many classes the levels before fill at most; the other word has how many classes
    this level fills, and which of these it is."""
    return (np.minimum(a, (1 << 30) - 1).astype(np.int64) << 32) | (np.minimum(b, (1 << 30) - 1).astype(np.int64) << 1) | kind


#: Parts of a signature's info.
FIRST, SECOND, KIND = "(info >> 32)", "((info >> 1) & 1073741823)", "(info & 1)"


def _may_link(i1: str, n1: str, m1: str, i2: str, n2: str, m2: str) -> str:
    """SQL: two holders of a signature must be compared.

    A rare shingle must be in the prefix that the other's size asks of each.  A combination
    counts at the first level where either set fills as many classes as the pair may break
    and one more, and there among that many of its classes."""
    part = lambda x, i: x.replace("info", i)
    e1, e2 = (f"({n} - ((4 * ({n1} + {n2}) + 8) div 9))" for n in (n1, n2))
    a1, a2, b1, b2 = part(FIRST, i1), part(FIRST, i2), part(SECOND, i1), part(SECOND, i2)
    spare = f"({e1} - {a1} + {e2} - {a2} + 1)"
    at = lambda m: f"({m} & 4294967295) < {spare}"
    level = f"{b1} < {spare} and {b2} < {spare} and case when ({m1} >> 32) >= {spare} then {at(m1)} when ({m2} >> 32) >= {spare} then {at(m2)} else false end"
    return f"({a1} <= {e1} and {a2} <= {e2} and ({part(KIND, i1)} = 0 or ({level})))"


def _signed(batches, words: int, frequent, kind):
    """Signature rows (key, node, n, info, more), and a row of each document (id, node, n, bitmap)."""
    seen: set[int] = set()
    common = frequent.value
    for batch in batches:
        for lo, hi in tx.slices(batch.column(1)):
            part = batch.slice(lo, hi - lo)
            s = Sets(tx.texts_of(part.column(1)), words)
            size = len(s.n)
            bitmap = pa.array(s.bitmaps(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()), pa.array(s.node), pa.array(s.n.astype(np.int32)), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), part.column(0), bitmap], names=["key", "node", "n", "info", "more", "id", "bitmap"])
            fresh = _fresh(s, seen)
            is_common = tx.member(common, s.g) >= 0
            rares = np.bincount(s.d[~is_common], minlength=size)
            e = errors(s.n)
            # rank among the rare shingles of the document
            before = np.cumsum(~is_common)
            start = np.concatenate(([0], before))[s.lo[:-1]]
            rank = before - 1 - start[s.d]
            plain = fresh & (rares > e)
            keep = plain[s.d] & ~is_common & (rank <= e[s.d])
            none = np.zeros(int(keep.sum()), np.int64)
            keys, owner, info, more = [s.g[keep]], [s.d[keep]], [pack(rank[keep], none, 0)], [none]
            for i in np.flatnonzero(fresh & (rares <= e)).tolist():
                a, b = s.lo[i], s.lo[i + 1]
                k, x, y = signatures(s.g[a:b], is_common[a:b])
                keys.append(k)
                owner.append(np.full(len(k), i))
                info.append(x)
                more.append(y)
            key, of = np.concatenate(keys), np.concatenate(owner)
            m = len(key)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(s.node[of]), pa.array(s.n[of].astype(np.int32)), pa.array(np.concatenate(info)), pa.array(np.concatenate(more)), pa.nulls(m, kind), pa.nulls(m, pa.binary())], names=["key", "node", "n", "info", "more", "id", "bitmap"])


def _sets(batches, words: int):
    for batch in batches:
        for lo, hi in tx.slices(batch.column(0)):
            s = Sets(tx.texts_of(batch.column(0).slice(lo, hi - lo)), words)
            yield pa.RecordBatch.from_arrays([pa.array(s.node), pa.array([s.g[a:b].tobytes() for a, b in zip(s.lo[:-1], s.lo[1:], strict=True)], pa.binary())], names=["node", "set"])


def differ_at_least(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets, from their bitmaps."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _maybe(batches):
    """Keeps the pairs that their bitmaps do not rule out."""
    for batch in batches:
        a, b, na, nb, x, y = (c.to_pylist() for c in batch.columns)
        keep = [9 * differ_at_least(p, q) <= m + n for p, q, m, n in zip(x, y, na, nb, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(batches):
    for batch in batches:
        keep = []
        for p, q in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
            both = np.concatenate((x, y))
            both.sort(kind="stable")
            keep.append(linked(len(x), len(y), int((both[1:] == both[:-1]).sum())))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


class Join:
    """The join over one table of documents."""

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, frequent: int = FREQUENT, max_frequent: int = MAX_FREQUENT, stars: int = 2, max_ids: int = 2_000_000):
        self.docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        self.words, self.stars, self.max_ids = words, stars, max_ids
        self.frequent, self.max_frequent = frequent, max_frequent
        self.spark = docs.sparkSession

    def _common(self) -> np.ndarray:
        """The frequent shingles, at most ``max_frequent``: those frequent in prefixes, and
        those frequent among what prefixes extend to for them."""
        first = self._often(None)
        return np.union1d(first, self._often(self.spark.sparkContext.broadcast(first))) if len(first) else first

    def _often(self, known) -> np.ndarray:
        words, most = self.words, self.max_frequent // 2
        counted = self.docs.select("text").mapInArrow(lambda it: _prefixes(it, words, known), "token long").groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") >= self.frequent)
        counted = store.keep(counted, "frequent")
        least, total = 0, 0
        for power, n in sorted(((r[0], r[1]) for r in counted.groupBy(F.floor(F.log2("c")).alias("p")).count().collect()), reverse=True):
            if total + n > most:
                least = 1 << (power + 1)
                break
            total += n
        got = np.asarray(counted.where(F.col("c") >= least).select("token").toArrow()["token"])
        store.drop(counted)
        store.tidy(self.spark)
        return np.sort(got.view(np.uint64))

    def _signed(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Kept tables: a row of each document (id, node, n); of each set (node, id, n,
        bitmap); of each signature that several sets have (key, node, n, info, more)."""
        words, spark = self.words, self.spark
        common = spark.sparkContext.broadcast(self._common())
        kind = self.docs.schema["id"].dataType.simpleString()
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(self.docs.schema["id"].dataType)
        signed = store.keep(self.docs.mapInArrow(lambda it: _signed(it, words, common, arrow), f"key long, node long, n int, info long, more long, id {kind}, bitmap binary"), "signed")
        rows = store.keep(signed.where("key is null").select("id", "node", "n"), "rows")
        nodes = store.keep(signed.where("key is null and n >= 4 and id is not null").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap")), "nodes")
        keys = signed.where("key is not null").select("key", "node", "n", "info", "more")
        shared = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select(F.col("key").alias("k"))
        posts = store.keep(keys.join(shared, F.col("key") == F.col("k")).select("key", "node", "n", "info", "more"), "posts")
        store.drop(signed)
        del signed, keys, shared
        store.tidy(spark)
        return rows, nodes, posts

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Every link between different sets, as pairs (a, b) of nodes, and the membership
        (id, node, n, copies, links): the rows of the same set, and the sets linked with it.
        All pairs that share a signature are verified, also those already connected: the work
        grows with the links, which :meth:`run` avoids."""
        rows, nodes, posts = self._signed()
        side = lambda x: posts.select(*(F.col(c).alias(f"{c}{x}") for c in ("key", "node", "n", "info", "more")))
        pairs = side("1").join(side("2"), F.expr(f"key1 = key2 and node1 < node2 and {_may_link('info1', 'n1', 'more1', 'info2', 'n2', 'more2')}"))
        found = self._verify(pairs.select(F.col("node1").alias("a"), F.col("node2").alias("b")).distinct(), nodes)
        store.drop(posts)
        count = found.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count("*").alias("links"))
        alike = rows.where("n > 0").groupBy(F.col("node").alias("y")).agg(F.count("*").alias("copies"))
        member = rows.join(alike, (F.col("node") == F.col("y")) & (F.col("n") > 0), "left").join(count, (F.col("node") == F.col("x")) & (F.col("n") > 0), "left")
        zero = F.lit(0).cast("long")
        return found, member.select("id", "node", "n", F.coalesce("copies", zero).alias("copies"), F.coalesce("links", zero).alias("links"))

    def run(self) -> DataFrame:
        """(id, n_shingles, component_id) of every row."""
        spark = self.spark
        rows, nodes, posts = self._signed()
        links = None
        labels = spark.createDataFrame([], "node long, comp long")
        for r in range(self.stars):
            found = self._verify(self._elected(posts, labels, r), nodes)
            links = found if links is None else store.keep(links.unionByName(found), "links")
            labels = components(links)
        found = self._verify(self._rest(posts, labels), nodes)
        if found.limit(1).count():
            links = store.keep(links.unionByName(found), "links") if links is not None else found
            labels = components(links)
        store.drop(posts)
        # the least id of each node, then of each component
        named = nodes.select("node", "id").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = named.groupBy("comp").agg(F.min("id").alias("component_id"))
        by_node = store.keep(named.join(least, "comp").select(F.col("node").alias("x"), "component_id"), "named")
        # sets of under 4 shingles link with equal sets only
        small = rows.where("n between 1 and 3 and id is not null").groupBy(F.col("node").alias("x")).agg(F.min("id").alias("component_id"))
        out = rows.join(by_node.unionByName(small), (F.col("node") == F.col("x")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left")
        return out.select("id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))

    def _elected(self, posts: DataFrame, labels: DataFrame, r: int) -> DataFrame:
        """Each node with the holder that most of its signatures elect, unless they are in one
        component.  A signature elects the holder that comes first in the round's order; in
        even rounds those of fewest rare shingles do, which near copies have in common."""
        few = F.when(F.expr(f"{KIND} = 1"), F.expr(FIRST)).otherwise(F.lit(0)) if r % 2 == 0 else F.lit(0)
        prio = F.struct(few.cast("long").alias("few"), F.xxhash64(F.lit(r), F.col("node")).alias("h"))
        first = posts.groupBy("key").agg(F.min(F.struct(prio.alias("p"), F.col("node").alias("node"), F.col("n").alias("n"), F.col("info").alias("info"), F.col("more").alias("more"))).alias("f"))
        first = first.select(F.col("key").alias("k"), F.col("f.node").alias("lead"), F.col("f.n").alias("m"), F.col("f.info").alias("j"), F.col("f.more").alias("l"))
        votes = posts.join(first, F.col("key") == F.col("k")).where(f"node <> lead and {_may_link('info', 'n', 'more', 'j', 'm', 'l')}").groupBy("node", "lead").agg(F.count("*").alias("votes"))
        best = votes.groupBy("node").agg(F.max(F.struct("votes", "lead")).alias("best")).select("node", F.col("best.lead").alias("lead"))
        if r:
            of = lambda name: labels.select(F.col("node").alias("x"), F.col("comp").alias(name))
            best = best.join(of("c1"), F.col("node") == F.col("x"), "left").drop("x").join(of("c2"), F.col("lead") == F.col("x"), "left").drop("x")
            best = best.where("coalesce(c1, node) <> coalesce(c2, lead)")
        return best.select(F.col("node").alias("a"), F.col("lead").alias("b"))

    def _rest(self, posts: DataFrame, labels: DataFrame) -> DataFrame:
        """All pairs that share a signature and are in different components.  Pairs of
        components are made first, then their members, so a component costs no square."""
        own = posts.distinct().join(labels.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").select("key", "node", "n", "info", "more", F.coalesce("comp", "node").alias("comp"))
        split = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select(F.col("key").alias("k"))
        own = store.keep(own.join(split, F.col("key") == F.col("k")).drop("k"), "split")
        # bounds of a component's holders rule out most pairs of components
        a, b = F.expr(FIRST), F.expr(SECOND)
        comps = own.groupBy("key", "comp").agg(F.min("n").alias("s"), F.max("n").alias("l"), F.min(a).alias("a"), F.min(b).alias("b"), F.first(F.expr(KIND)).alias("kind"))
        one, other = (comps.select(*(F.col(c).alias(f"{c}{i}") for c in comps.columns)) for i in (1, 2))
        e1, e2 = "(l1 - ((4 * (l1 + s2) + 8) div 9))", "(l2 - ((4 * (l2 + s1) + 8) div 9))"
        spare = f"({e1} - a1 + {e2} - a2 + 1)"
        two = one.join(other, F.expr(f"key1 = key2 and comp1 < comp2 and a1 <= {e1} and a2 <= {e2} and (kind1 = 0 or (b1 < {spare} and b2 < {spare}))")).select("key1", "comp1", "comp2")
        left = own.select(F.col("key").alias("k1"), F.col("node").alias("na"), F.col("n").alias("sa"), F.col("info").alias("ia"), F.col("more").alias("xa"), F.col("comp").alias("m1"))
        right = own.select(F.col("key").alias("k2"), F.col("node").alias("nb"), F.col("n").alias("sb"), F.col("info").alias("ib"), F.col("more").alias("xb"), F.col("comp").alias("m2"))
        pairs = two.join(left, (F.col("key1") == F.col("k1")) & (F.col("comp1") == F.col("m1"))).join(right, (F.col("key1") == F.col("k2")) & (F.col("comp2") == F.col("m2")) & F.expr(_may_link("ia", "sa", "xa", "ib", "sb", "xb")))
        pairs = pairs.select(F.col("na").alias("a"), F.col("nb").alias("b"))
        return pairs.select("a", "b").distinct()

    def _verify(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs whose sets link."""
        end = lambda x: nodes.select(F.col("node").alias(f"x{x}"), F.col("n").alias(f"n{x}"), F.col("bitmap").alias(f"s{x}"))
        wide = pairs.join(end("a"), F.col("a") == F.col("xa")).join(end("b"), F.col("b") == F.col("xb"))
        maybe = store.keep(wide.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_maybe, "a long, b long"), "maybe")
        ends = maybe.select(F.col("a").alias("x")).unionByName(maybe.select(F.col("b").alias("x"))).distinct()
        ids = store.keep(nodes.join(ends, F.col("node") == F.col("x")).select("id"), "ends")
        words = self.words
        sets = store.only_ids(self.docs, ids, "id", self.max_ids).select("text").mapInArrow(lambda it: _sets(it, words), "node long, set binary")
        sets = store.keep(sets, "sets")
        # the elected end of a pair is shared by many: it joins last
        one = maybe.join(sets.select(F.col("node").alias("xa"), F.col("set").alias("sa")), F.col("a") == F.col("xa"))
        both = one.join(sets.select(F.col("node").alias("xb"), F.col("set").alias("sb")), F.col("b") == F.col("xb"))
        with store.small_batches(self.spark):
            found = store.keep(both.select("a", "b", "sa", "sb").mapInArrow(_links, "a long, b long").distinct(), "links")
        for x in (sets, ids, maybe):
            store.drop(x)
        return found


def join(docs: DataFrame, **options) -> DataFrame:
    """(id, n_shingles, component_id) of every document; see :class:`Join`."""
    return Join(docs, **options).run()


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(store.table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document of least id stays (null ids after all others).  Rows
    are told apart by id and text, so a text is never lost to another that shares its id; of
    rows that repeat both, one stays."""
    store.bound_batches(spark)
    # an id that no two different rows share: nulls last, then the id, then the text
    key = F.struct(docs["doc_id"].isNull().alias("z"), docs["doc_id"].alias("i"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("h"))
    names = docs.columns
    rows = docs.select(F.struct(*(docs[c] for c in names)).alias("row"), key.alias("k"))
    gone = store.keep(join(rows.select("k", "row.text"), id_col="k").where("component_id <> id").select(F.col("id").alias("k")).distinct(), "copies")
    left = store.only_ids(rows, gone, "k", how="left_anti")
    again = store.keep(rows.select("k").groupBy("k").count().where("count > 1").select("k"), "repeated")
    if again.limit(1).count():
        one = store.only_ids(left, again, "k").groupBy("k").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        left = store.only_ids(left, again, "k", how="left_anti").unionByName(one, allowMissingColumns=False)
    return left.select("row.*")
