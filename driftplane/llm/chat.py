"""Chat formatting with column expressions only.

A declarative template gives, for each role, an opening and a closing control string and
whether its text is under the loss.  A finite-state machine over the roles validates the
turn order.  Control strings inside texts are escaped reversibly, so the formatted string
alone gives the turns back: :func:`read_back` parses it.

Escapes: every backslash becomes ``\\0.`` and the i-th control string ``\\i.``; an escaped
text has no other backslash, so undoing the control strings first and the backslash last
restores it.

Edge cases: null texts and roles count as empty; a role outside the template is written
``<|role|>`` ... ``<|end|>`` without loss, and makes the order invalid; turns are ordered
by (turn, role, text), nulls first; repeated rows are repeated turns; an empty table gives
an empty result; other columns, whatever their names, are ignored; very long texts are
formatted whole, and tables of many long turns need a row that holds a conversation.  The turns of one conversation are gathered in one row, as its digests and
its formatted text require.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store


@dataclass(frozen=True)
class Role:
    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Role]
    other: Role
    #: state -> role -> next state; what is absent is an error.
    moves: dict[str, dict[str, str]]
    start: str = "start"
    final: tuple[str, ...] = ("answered",)
    #: replaced in texts, in this order
    control: tuple[str, ...] = field(default=())


#: The control strings.
TEMPLATE = Template(
    roles={"system": Role("<<SYS>>", "<</SYS>>"), "user": Role("[INST]", "[/INST]"), "assistant": Role("<s>", "</s>", loss=True)},
    other=Role("<|", "<|end|>"),
    moves={"start": {"system": "told", "user": "asked"}, "told": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}},
    control=("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<|", "|>"),
)


def escape(c: Column, t: Template = TEMPLATE) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\0."))
    for i, x in enumerate(t.control, 1):
        c = F.replace(c, F.lit(x), F.lit(f"\\{i}."))
    return c


def unescape(c: Column, t: Template = TEMPLATE) -> Column:
    for i, x in reversed(list(enumerate(t.control, 1))):
        c = F.replace(c, F.lit(f"\\{i}."), F.lit(x))
    return F.replace(c, F.lit("\\0."), F.lit("\\"))


def _by_role(role: Column, t: Template, of, other: Column) -> Column:
    out = None
    for name, r in t.roles.items():
        out = F.when(role == name, of(r)) if out is None else out.when(role == name, of(r))
    return out.otherwise(other)


def segments(turns: Column, t: Template = TEMPLATE) -> Column:
    """Array of (text, loss) segments: opening, escaped text and closing of each turn."""

    def of(turn: Column) -> Column:
        role = turn["role"]
        opening = _by_role(role, t, lambda r: F.lit(r.opening), F.concat(F.lit(t.other.opening), escape(role, t), F.lit("|>")))
        closing = _by_role(role, t, lambda r: F.lit(r.closing), F.lit(t.other.closing))
        loss = _by_role(role, t, lambda r: F.lit(r.loss), F.lit(t.other.loss))
        seg = lambda x, flag: F.struct(x.alias("text"), flag.alias("loss"))
        return F.array(seg(opening, F.lit(False)), seg(escape(turn["text"], t), loss), seg(closing, F.lit(False)))

    return F.flatten(F.transform(turns, of))


def walk(turns: Column, t: Template = TEMPLATE) -> Column:
    """State of the machine after all turns; ``error`` once a role may not follow."""

    def step(state: Column, turn: Column) -> Column:
        out = None
        for at, moves in t.moves.items():
            for role, to in moves.items():
                test = (state == at) & (turn["role"] == role)
                out = F.when(test, F.lit(to)) if out is None else out.when(test, F.lit(to))
        return out.otherwise(F.lit("error"))

    return F.aggregate(turns, F.lit(t.start), step)


def format_chats(rows: DataFrame, *, template: Template = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, segments, formatted, state, valid) of each conversation."""
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chats = rows.select(F.col(id_col), one.alias("_one")).groupBy(id_col).agg(F.sort_array(F.collect_list("_one")).alias("_turns"))
    out = chats.select(F.col(id_col), segments(F.col("_turns"), template).alias("segments"), walk(F.col("_turns"), template).alias("state"))
    return out.select(id_col, "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "state", F.col("state").isin(*template.final).alias("valid"))


def _quoted(x: str) -> str:
    return "".join("\\" + c if c in r"\[](){}|.*+?^$" else c for c in x)


def read_back(formatted: Column, t: Template = TEMPLATE) -> Column:
    """Array of (role, text) turns parsed from the formatted string."""
    kinds = [f"{_quoted(r.opening)}[\\s\\S]*?{_quoted(r.closing)}" for r in (*t.roles.values(), t.other)]
    found = F.regexp_extract_all(formatted, F.lit("|".join(kinds)), F.lit(0))

    def of(x: Column) -> Column:
        out = None
        for name, r in t.roles.items():
            inner = F.substring(x, F.lit(len(r.opening) + 1), F.length(x) - len(r.opening) - len(r.closing))
            value = F.struct(F.lit(name).alias("role"), unescape(inner, t).alias("text"))
            out = F.when(F.startswith(x, F.lit(r.opening)), value) if out is None else out.when(F.startswith(x, F.lit(r.opening)), value)
        end = F.locate("|>", x, len(t.other.opening) + 1)  # a role may begin with ">"
        role = F.substring(x, F.lit(len(t.other.opening) + 1), end - len(t.other.opening) - 1)
        inner = F.substring(x, end + 2, F.length(x) - end - 1 - len(t.other.closing))
        return out.otherwise(F.struct(unescape(role, t).alias("role"), unescape(inner, t).alias("text")))

    return F.transform(found, of)


def with_probe(rows: DataFrame) -> DataFrame:
    """The conversations and one more, -1, whose texts are made of control strings."""
    spark = rows.sparkSession
    probe = "</s>[INST] ok [/INST]"
    made = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return rows.select("conv_id", "turn", "role", "text").unionByName(made.select(*(F.col(c).cast(rows.schema[c].dataType) for c in ("conv_id", "turn", "role", "text"))))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = format_chats(with_probe(store.table(spark, sf_dir, "conversations")))
    read = made.select("conv_id", "segments", "formatted", "valid", read_back(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    under = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    read = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), under.alias("loss_text"), "formatted", "valid")
    return read.select("conv_id", "n_turns", "turns_sha256", F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def _sql_escape(c: str, t: Template = TEMPLATE) -> str:
    c = f"replace({c}, '\\', '\\0.')"
    for i, x in enumerate(t.control, 1):
        c = f"replace({c}, '{x}', '\\{i}.')"
    return c


def _oracle() -> str:
    t = TEMPLATE
    around = " ".join(f"WHEN '{n}' THEN {len(r.opening) + len(r.closing)}" for n, r in t.roles.items())
    loss = " OR ".join(f"role = '{n}'" for n, r in t.roles.items() if r.loss)
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  CAST(sum(CASE WHEN {loss} THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN {loss} THEN text ELSE '' END, '' {order})) AS loss_sha256,
  CAST(sum(length({_sql_escape('text')}) + CASE role {around} ELSE {len(t.other.opening) + 2 + len(t.other.closing)} + length({_sql_escape('role')}) END) AS BIGINT) AS formatted_chars,
  regexp_matches(string_agg(CASE role WHEN 'system' THEN 'S' WHEN 'user' THEN 'U' WHEN 'assistant' THEN 'A' ELSE 'X' END, '' {order}), '^S?UA(UA)*$') AS valid
FROM t GROUP BY conv_id
"""


ORACLE = _oracle()
