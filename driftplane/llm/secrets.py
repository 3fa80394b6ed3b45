"""Secret scan with a random forest that removes false positives, in column expressions.

Candidates are runs of 16 token characters or more with a digit or a capital after a small
letter, quoted values of 8 characters or more after ``:`` or ``=``, and unquoted ones of 8
characters or more after a word that tells of secrets and ``:`` or ``=``; a name and the
``=`` after it are no part of a value.  Nothing limits a value's length.  Each is described
by its length, character transitions (runs of a class, and the log odds of class bigrams),
dictionary coverage, path shape, and the words next to it.  A random forest over these
features, fitted in numpy on the driver from labelled findings (a bounded, seeded list by
default), is flattened to literal arrays; scoring walks them with ``aggregate``, so the
executors run no Python.

Every occurrence in the whole text is reported, with its offsets in code points.  The work
is linear in a text's length: one pattern whose parts begin at rare characters, features
made once a candidate, offsets as running sums in blocks.

Edge cases: null and empty texts have no findings; very long texts, long tokens and many
candidates are scanned whole; repeated rows each report theirs; an empty table gives an
empty result; a null id is carried as it is; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

TELLS = "token secret password passwd pwd passphrase apikey api_key api-key access_key private_key credential auth bearer".split()
_T = "A-Za-z0-9_/+.\\-"
_TELL = f"(?i:{'|'.join(TELLS)})"
# a "=" of a value: one before the value's end or beside another; any other ends a name
_EQ = "=(?![.]{0,4}+[A-Za-z0-9_/+\\-])|(?<==)="
_GAP = "[ \\t]{0,4}+"
#: ":" or "=" after a tell word, or after "authorization" and before one.
_LEAD = f"(?=[:=])(?:(?<={_TELL}[^A-Za-z0-9]{{0,4}})[:=]{_GAP}|(?<=(?i:authorization)[\"']?[ \\t]{{0,2}})[:=]{_GAP}[\"']?{_TELL}[ \\t]{{1,4}}+)"
_TOLD = "(?=[^\\s\"'=])(?:(?![,;)\\]}>`]{0,8}+(?:[\\s\"'<]|$)|&[A-Za-z0-9_.\\-]{1,40}+=)[^\\s\"'<]){8,}+"
_QUOTED = "[^\\s\"']{8,}+(?=[\"'])"
_RUN = f"(?=[{_T}=]{{16}})(?=(?:[A-Z_/+.\\-]|[a-z](?![A-Z])|{_EQ})*+(?:[0-9]|[a-z][A-Z]))(?:[{_T}]|{_EQ}){{16,}}+"
#: A match is a lead, if any, and the value (group 4); the empty groups say which lead it is.
CANDIDATE = f"(?:{_LEAD}()|(?<![{_T}])(?<!==)()|(?<=[:=] ?[\"'])())(\\1{_TOLD}|\\2{_RUN}|\\3{_QUOTED})"
#: Words that secrets hardly hold, words next to secrets, words next to others.
DICTIONARY = "the and that for with from this have not are was you example sample test demo user name mail data file path index image page site home http https www com org net html json text table value default config local public static source version release build number list item type class string status result content document module package license apache your here changeme dummy placeholder get set add new old code admin server client host port cache time date day year start stop first last next open close read write load save send run make create update delete remove insert select query search sort group count total title label color size width height left right main menu row column field form input output error warning info debug event handler function method object array integer float double boolean true false null world house water people work part place case week company system program question night point area money story fact month study book word business issue side kind head service friend father power hour game line member city".split()
DENIES = "sha1 sha256 md5 checksum hash digest commit revision uuid guid etag integrity serial order invoice isbn tracking example sample".split()
FEATURES = ("log_length", "runs_rate", "bigram_odds", "digit_rate", "upper_rate", "distinct_rate", "coverage", "slashes", "dots", "url_before", "extension", "tell", "deny", "assigned", "quoted", "mail", "hex_length", "repeats")
_CLASSES = "vcUds"


def _class_of(c: str) -> str:
    if c in "aeiou":
        return "v"
    if c.islower():
        return "c"
    if c.isupper():
        return "U"
    return "d" if c.isdigit() else "s"


def classes(value: Column) -> Column:
    """The value with each character as its class."""
    for pattern, to in (("[aeiou]", "\\u0001"), ("[a-z]", "\\u0002"), ("[A-Z]", "\\u0003"), ("[0-9]", "\\u0004"), ("[^\\x01-\\x04]", "s")):
        value = F.regexp_replace(value, pattern, to.encode().decode("unicode_escape"))
    return F.translate(value, "\x01\x02\x03\x04", "vcUd")


def made(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are evaluated once a row: the optimizer moves no expression
    through a generator, so what reads them does not evaluate them again."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def running(xs: Column, block: int = 64, levels: int = 3) -> Column:
    """Running sums of an array of numbers: sums within blocks, and of the blocks before."""
    if levels == 0:
        zero = F.array().cast("array<long>")
        return F.aggregate(xs, zero, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)))
    starts = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int"))
    parts = F.transform(starts, lambda b: running(F.slice(xs, b * block + 1, block), block, 0))
    upto = lambda sums: running(F.transform(sums, lambda p: F.element_at(p, -1)), block, levels - 1 if levels > 1 else 0)
    # the block sums are made once: an array of one element, transformed
    whole = F.transform(F.array(parts), lambda p: F.struct(p.alias("p"), upto(p).alias("u")))
    joined = F.transform(whole, lambda w: F.flatten(F.transform(w["p"], lambda p, i: F.transform(p, lambda x: x + F.coalesce(F.get(w["u"], i - 1), F.lit(0))))))
    return F.when(F.size(xs) > 0, F.get(joined, 0)).otherwise(F.array().cast("array<long>"))


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, value, before, after) of every candidate of every text."""
    found = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).where(F.col("_t").rlike(CANDIDATE))
    all_of = lambda group: F.regexp_extract_all("_t", F.lit(CANDIDATE), F.lit(group))
    found = made(found, _m=all_of(0), _v=all_of(4), _g=F.split("_t", CANDIDATE, -1)).drop("_t")
    # gap i stands before match i; its length and the match's add up to the offsets
    steps = F.zip_with(F.slice("_g", 1, F.size("_v")), "_m", lambda g, m: (F.length(g) + F.length(m)).cast("long"))
    found = made(made(found, _s=steps), _e=running(F.col("_s")))
    lead = lambda i: F.left(F.element_at("_m", i), F.length(F.element_at("_m", i)) - F.length(F.element_at("_v", i)))
    before = lambda i: F.right(F.concat(F.coalesce(F.get("_v", i - 2), F.lit("")), F.element_at("_g", i), lead(i)), F.lit(48))
    rows = F.transform(F.sequence(F.lit(1), F.size("_v")), lambda i: F.struct(F.element_at("_e", i).alias("end"), F.element_at("_v", i).alias("value"), before(i).alias("before"), F.left(F.element_at("_g", i + 1), F.lit(24)).alias("after")))
    found = found.select("_id", F.explode(rows).alias("r"))
    return found.select(F.col("_id").alias(id_col), (F.col("r.end") - F.length("r.value")).alias("start"), F.col("r.end").alias("end"), "r.value", "r.before", "r.after")


def features(rows: DataFrame, odds: dict[str, float]) -> DataFrame:
    """``rows`` (value, before, after) with FEATURES as the array ``x``, made once a row."""
    rows = made(rows, _low=F.lower("value"), _pairs=F.regexp_extract_all(classes(F.col("value")), F.lit("(?=(..))"), F.lit(1)))
    v, before, after = F.col("value"), F.lower("before"), F.lower("after")
    n = F.greatest(F.length(v), F.lit(1))
    low = F.col("_low")
    rest = lambda pattern: F.length(F.regexp_replace(v, pattern, ""))
    rate = lambda pattern: 1 - rest(pattern) / n
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    table = F.create_map(*(x for k, o in odds.items() for x in (F.lit(k), F.lit(float(o)))))
    bigrams = F.aggregate("_pairs", F.lit(0.0), lambda acc, p: acc + F.coalesce(F.element_at(table, p), F.lit(0.0)))
    one = {
        "log_length": F.log(n.cast("double")),
        "runs_rate": F.length(F.regexp_replace(v, "[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+", "x")) / n,
        "bigram_odds": bigrams / n,
        "digit_rate": rate("[0-9]"),
        "upper_rate": rate("[A-Z]"),
        "distinct_rate": F.size(F.array_distinct(F.split(v, ""))) / F.sqrt(n.cast("double")),
        "coverage": 1 - F.length(F.regexp_replace(low, "|".join(DICTIONARY), "")) / n,
        "slashes": (F.length(v) - rest("/")).cast("double"),
        "dots": (F.length(v) - rest("[.]")).cast("double"),
        "url_before": flag(before.rlike("(://|www[.]|[a-z]/)$")),
        "extension": flag(low.rlike("[.](html?|php|js|css|png|jpe?g|gif|pdf|txt|xml|json|py|java|md|com|org|net|de|fr|es|example)([/?#].*)?$")),
        "tell": flag(before.rlike("(" + "|".join(TELLS) + ")[^a-z0-9]{0,8}$")),
        "deny": flag(before.rlike("(" + "|".join(DENIES) + ")[^a-z0-9]{0,8}$")),
        "assigned": flag(before.rlike("[:=]\\s?[\"']?$")),
        "quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "mail": flag(before.endswith("@") | after.startswith("@")),
        "hex_length": F.when(low.rlike("^[0-9a-f-]+$"), F.length(v)).otherwise(0).cast("double"),
        "repeats": rate("(.)\\1{2,}"),
    }
    return made(rows, x=F.array(*(one[k].cast("double") for k in FEATURES))).drop("_low", "_pairs")


def findings(n: int = 3000, seed: int = 0) -> list[tuple[str, str, str, int]]:
    """Labelled findings (value, before, after, label), generated from a seed."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    run = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    hexa, digits = "0123456789abcdef", "0123456789"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    full = upper + lower + digits
    parts = "an en er ti on th re st in le de la ou ch ei au ver ung que mi co da so na".split()
    word = lambda: "".join(pick(parts) for _ in range(int(r.integers(1, 5))))
    prose = lambda: " ".join(word() for _ in range(int(r.integers(1, 6))))

    def secret() -> tuple[str, str, str, int]:
        value = pick([lambda: run(hexa, pick((32, 40, 40, 64))), lambda: run(full, int(r.integers(20, 64))), lambda: "AKIA" + run(upper + digits, 16), lambda: "ghp_" + run(full, 36), lambda: "sk-" + run(full, 40), lambda: run(full + "+/", 43) + "=", lambda: run(full + "_.-", int(r.integers(10, 16)))])()
        if r.random() < 0.1:
            value = value.upper()
        tell = pick(TELLS)
        if r.random() < 0.1:
            tell = tell.upper()
        q = pick('""\'')
        form = pick([f"{tell} = {q}", f"{tell}={q}", f"{tell}: {q}", f'{tell}" : {q}', f"{tell}: ", f"{tell}=", f"authorization: {tell} "])
        close = form[-1] if form[-1] in "\"'" else " "
        return value, f"{prose()} {form}", close + pick([" ", "\n", ", "]) + prose(), 1

    def other() -> tuple[str, str, str, int]:
        uuid = lambda: "-".join(run(hexa, k) for k in (8, 4, 4, 4, 12))
        value, before = pick(
            [
                lambda: (f"{word()}{word()}-{word()}{run(digits, int(r.integers(1, 4)))}.{word()}." + pick(["com", "org", "net", "io", "co.uk"]), f"{prose()} {word()}{run(digits, 2)}@"),
                lambda: ("/".join(word() for _ in range(4)) + f"/{run(digits, 4)}.html", pick([prose() + " ", "https://"])),
                lambda: (uuid(), pick([prose() + " ", "uuid: ", 'id = "'])),
                lambda: (run(hexa, pick((32, 40, 64))), pick(DENIES) + pick([": ", " ", '="', " = "])),
                lambda: (f"{word()}{word()}{word()}-{run(digits, 3)}.{word()}", prose() + " "),
                lambda: (run(digits, int(r.integers(16, 22))), prose() + pick([" ", ' = "', ": "])),
                lambda: (f"{run(digits, 4)}-{run(digits, 2)}-{run(digits, 2)}T{run(digits, 2)}.{run(digits, 2)}", prose() + pick([" ", ' date = "'])),
                lambda: (pick(["your-token-here-1", "changeme12345678", "example_password1", "xxxxxxxxxxxxxxxx0", "test-api-key-00001", "dummy-secret-12345"]), pick(TELLS) + pick([' = "', ": ", "="])),
                lambda: ("_".join(word() for _ in range(4)) + run(digits, 2), prose() + pick([" ", ' name = "'])),
                lambda: ("".join(word().capitalize() for _ in range(int(r.integers(3, 7)))), prose() + pick([" ", "class ", ' = "', "://"])),
                lambda: (word() + "".join(word().capitalize() for _ in range(int(r.integers(3, 6)))), prose() + pick([" ", "(", "."])),
                lambda: (word() + "=" * int(r.integers(10, 30)) + run(digits, 1), prose() + " "),
                lambda: (word() + word() + word(), prose() + pick([' = "', ': "'])),
                lambda: (f"v{run(digits, 1)}.{run(digits, 2)}.{run(digits, 3)}-{word()}{word()}", "release "),
            ]
        )()
        return value, before, (before[-1] if before[-1] in "\"'" else " ") + prose(), 0

    return [secret() if r.random() < 0.5 else other() for _ in range(n)]


def bigram_odds(rows: list[tuple[str, str, str, int]]) -> dict[str, float]:
    """Log odds of each bigram of character classes among secrets against others."""
    counts = np.ones((2, 25))
    for value, _, _, label in rows:
        c = [_CLASSES.index(_class_of(x)) for x in value]
        for a, b in zip(c, c[1:], strict=False):
            counts[label, 5 * a + b] += 1
    p = counts / counts.sum(1, keepdims=True)
    odds = np.log(p[1] / p[0])
    return {_CLASSES[i // 5] + _CLASSES[i % 5]: float(round(odds[i], 4)) for i in range(25)}


@dataclass
class RandomForest:
    """Trees of one flat set of node arrays; a leaf's children are itself."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]
    roots: list[int]
    depth: int
    odds: dict[str, float]

    def score(self, x: Column) -> Column:
        """Mean of the trees' leaves, as a column over the feature array ``x``."""
        arrays = {k: F.array(*map(F.lit, getattr(self, k))) for k in ("feature", "threshold", "left", "right", "value", "roots")}
        at = lambda k, i: F.get(arrays[k], i)
        down = lambda node: F.when(F.get(x, at("feature", node)) <= at("threshold", node), at("left", node)).otherwise(at("right", node))
        leaf = lambda root: F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), root, lambda node, _: down(node))
        return F.aggregate(arrays["roots"], F.lit(0.0), lambda total, root: total + at("value", leaf(root))) / len(self.roots)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        f, t, lo, hi, v = (np.array(a) for a in (self.feature, self.threshold, self.left, self.right, self.value))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[np.arange(len(x)), f[at]] <= t[at], lo[at], hi[at])
            out += v[at]
        return out / len(self.roots)


def fit(x: np.ndarray, y: np.ndarray, odds: dict[str, float], *, trees: int = 24, depth: int = 6, min_leaf: int = 3, seed: int = 0) -> RandomForest:
    """Bootstrap samples, a random subset of features at each node, Gini impurity."""
    r, n_features = np.random.default_rng(seed), x.shape[1]
    nodes: list[list] = []

    def grow(rows: np.ndarray, left: int) -> int:
        at, p = len(nodes), float(y[rows].mean())
        nodes.append([0, float("inf"), at, at, p])
        if left == 0 or p in (0.0, 1.0) or len(rows) < 2 * min_leaf:
            return at
        best = (1e-9, 0, 0.0)
        for j in r.choice(n_features, max(2, int(np.sqrt(n_features)) + 1), replace=False):
            order = np.argsort(x[rows, j], kind="stable")
            s, t = x[rows[order], j], y[rows[order]]
            k = np.arange(1, len(s))
            ones = np.cumsum(t)[:-1]
            impurity = ones * (1 - ones / k) + (t.sum() - ones) * (1 - (t.sum() - ones) / (len(s) - k))
            gain = len(s) * p * (1 - p) - impurity
            gain[(s[1:] == s[:-1]) | (k < min_leaf) | (len(s) - k < min_leaf)] = 0
            c = int(gain.argmax())
            if gain[c] > best[0]:
                best = (float(gain[c]), int(j), float((s[c] + s[c + 1]) / 2))
        if best[0] <= 1e-9:
            return at
        go = x[rows, best[1]] <= best[2]
        nodes[at][:2] = best[1:]
        nodes[at][2] = grow(rows[go], left - 1)
        nodes[at][3] = grow(rows[~go], left - 1)
        return at

    roots = [grow(r.integers(0, len(x), len(x)), depth) for _ in range(trees)]
    f, t, lo, hi, v = map(list, zip(*nodes, strict=True))
    return RandomForest(f, t, lo, hi, v, roots, depth, odds)


@functools.cache
def _default(spark: SparkSession, n: int, seed: int) -> RandomForest:
    return train(spark, findings(n, seed))


def train(spark: SparkSession, rows: list[tuple[str, str, str, int]], **options) -> RandomForest:
    """Fits on labelled findings; their features come from the same columns as scoring."""
    odds = bigram_odds(rows)
    table = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "i int, value string, before string, after string, label int")
    got = features(table, odds).select("i", "x", "label").collect()
    got.sort(key=lambda row: row[0])
    return fit(np.array([row[1] for row in got]), np.array([row[2] for row in got], float), odds, **options)


def scan(docs: DataFrame, *, model: RandomForest | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, start, end, value, score, is_secret) of every candidate of every document."""
    model = model or _default(docs.sparkSession, 3000, 0)
    rows = features(candidates(docs, id_col=id_col, text_col=text_col), model.odds)
    return rows.withColumn("score", model.score(F.col("x"))).select(id_col, "start", "end", "value", "score", (F.col("score") >= threshold).alias("is_secret"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(store.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "is_secret")
