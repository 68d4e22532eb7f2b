"""Conversations as budgeted training windows. DataFrame operations only.

A conversation's turns are laid end to end by prefix sums of their tokens and cut at turns into spans: the turns that begin
within the same stretch of tokens. A window is the system turn, a limited history before the span, and the span. Only
assistant texts of the span itself are targets, so each is a target once however often it is repeated as history.

    <|im_start|>role
    text<|im_end|>

In roles and texts ``~`` becomes ``~0`` and ``<|`` becomes ``~1``, in roles a line feed ``~2``; so no text holds a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The marks of the template.
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens of a stretch, turns of history at most, and tokens of it at most.
STRETCH, HISTORY, HISTORY_TOKENS = 512, 2, 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("<|"), F.lit("~1"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~1"), F.lit("<|")), F.lit("~0"), F.lit("~"))


def _sum(items: Column, of) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + of(x))


def windows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", stretch: int = STRETCH, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """``(conv_id, windows)``: a row a conversation, with an array of windows in order.

    A window has ``text``, ``context`` (its first turns, which an earlier window had: the system turn and history) and
    ``targets``: ``(start, length)`` in code points of what is learned. Turns stand by number, then by role and text, so
    ties have one order; null roles and texts count as empty. Tokens are words (runs of other than space and the
    characters 9 to 13) and three marks a turn. The system turn is the first one, if its role is ``system``. A span
    exceeds its stretch by its last turn at most, and a turn is never cut, however long. Repeated rows are turns. Rows
    without a conversation id are one conversation. Extra columns are left out; an empty table gives no rows.

    Prefix sums of tokens and characters are running sums over a conversation's sorted turns, so nothing grows with the square
    of its length. A conversation is put together in one row, as its windows ask; conversations are spread by id.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    tokens = (F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) + 3).cast("long")
    head = F.concat(F.lit(BEGIN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("~2")), F.lit("\n"))
    rows = rows.select("conv_id", "turn", "role", "text", tokens.alias("tokens"), head.alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.withColumn("long", (F.char_length("head") + F.char_length("body") + len(END)).cast("long"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # Where a turn stands, and where it begins in tokens and in characters of all turns.
    place = {"pos": F.row_number().over(order), "begins": F.coalesce(F.sum("tokens").over(before), F.lit(0)), "at": F.coalesce(F.sum("long").over(before), F.lit(0))}
    rows = rows.withColumns(place).select("conv_id", F.struct("pos", "begins", "at", "long", "role", "head", "body").alias("t"))
    conv = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    begins = lambda k: F.element_at("turns", k)["begins"]
    cuts = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda k: (k == 1) | (F.floor(begins(k) / stretch) != F.floor(begins(F.greatest(k - 1, F.lit(1))) / stretch)))
    conv = conv.withColumn("cuts", cuts).withColumn("system", (F.element_at("turns", 1)["role"] == "system").cast("int"))

    def window(k: Column) -> Column:
        first = F.element_at("cuts", k)
        after = F.when(k < F.size("cuts"), F.element_at("cuts", F.least(k + 1, F.size("cuts")))).otherwise(F.size("turns") + 1)
        # The earliest turn of the history: neither too many turns nor too many tokens before the span.
        options = F.sequence(F.greatest(first - history, F.col("system") + 1), F.greatest(first, F.col("system") + 1))
        near = F.filter(options, lambda h: (h < first) & (begins(first) - begins(h) <= history_tokens))
        start = F.when(first > F.col("system") + 1, F.coalesce(F.get(near, F.lit(0)), first)).otherwise(first)
        context = F.concat(F.when((first > 1) & (F.col("system") == 1), F.slice("turns", 1, 1)).otherwise(F.slice("turns", 1, 0)), F.slice("turns", start, first - start))
        return F.struct(context.alias("context"), F.slice("turns", first, after - first).alias("span"))

    spans = F.transform(F.sequence(F.lit(1), F.size("cuts")), window)
    whole = lambda t: F.concat(t["head"], t["body"], F.lit(END))

    def formatted(w: Column) -> Column:
        # The span's turns stand together, after the context.
        shift = _sum(w["context"], lambda t: t["long"]) - F.element_at(w["span"], 1)["at"]
        learned = F.transform(F.filter(w["span"], lambda t: t["role"] == "assistant"), lambda t: F.struct((shift + t["at"] + F.char_length(t["head"])).alias("start"), F.char_length(t["body"]).cast("long").alias("length")))
        return F.struct(F.array_join(F.transform(F.concat(w["context"], w["span"]), whole), "").alias("text"), F.size(w["context"]).alias("context"), learned.alias("targets"))

    return conv.withColumn("spans", spans).select("conv_id", F.transform("spans", formatted).alias("windows"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, turns, learned)``: the turns ``(role, text)`` and the texts under the targets, from the windows alone."""

    def turn(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(len(BEGIN) + 1))
        cut = F.instr(inner, "\n")
        role = F.replace(F.substr(inner, F.lit(1), cut - 1), F.lit("~2"), F.lit("\n"))
        return F.struct(unescape(role).alias("role"), unescape(F.substr(inner, cut + 1)).alias("text"))

    def turns(w: Column) -> Column:
        pieces = F.split(w["text"], r"<\|im_end\|>\n", -1)
        # The last piece is what stands after the last mark: nothing.
        own = F.slice(pieces, w["context"] + 1, F.size(pieces) - 1 - w["context"])
        return F.transform(own, turn)

    learned = F.flatten(F.transform("windows", lambda w: F.transform(w["targets"], lambda t: unescape(F.substr(w["text"], (t["start"] + 1).cast("int"), t["length"].cast("int"))))))
    return formatted.select("conv_id", F.flatten(F.transform("windows", turns)).alias("turns"), learned.alias("learned"), "windows")


#: The conversation that holds another template's marks in its texts.
MARKED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
_MARKED_SQL = "SELECT * FROM VALUES " + ", ".join(f"(CAST({c} AS BIGINT), CAST({t} AS BIGINT), '{r}', '{x}')" for c, t, r, x in MARKED) + " AS t(conv_id, turn, role, text)"


def op9(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    back = read_back(windows(rows.unionByName(spark.sql(_MARKED_SQL))))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("learned", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), _sum(F.col("windows"), lambda w: F.char_length(w["text"])).alias("formatted_chars"))


ORACLE_OP9 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES {", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in MARKED)}) v(conv_id, turn, role, text)),
t AS (SELECT *, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + 3 AS tokens,
  {len(BEGIN) + 1 + len(END)} + length(replace(replace(replace(role, '~', '~0'), '<|', '~1'), chr(10), '~2')) + length(replace(replace(text, '~', '~0'), '<|', '~1')) AS long,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM c),
b AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - tokens AS begins, max(CASE WHEN pos = 1 AND role = 'system' THEN long ELSE 0 END) OVER (PARTITION BY conv_id) AS system FROM t),
k AS (SELECT *, pos > 1 AND begins // {STRETCH} <> lag(begins) OVER (PARTITION BY conv_id ORDER BY pos) // {STRETCH} AS cut FROM b),
h AS (SELECT x.conv_id, sum(y.long) AS history FROM k x JOIN k y ON x.conv_id = y.conv_id AND x.cut AND y.pos BETWEEN greatest(x.pos - {HISTORY}, (x.system > 0)::INT + 1) AND x.pos - 1 AND x.begins - y.begins <= {HISTORY_TOKENS} GROUP BY 1),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss, sum(long) + sum(CASE WHEN cut THEN system ELSE 0 END) AS chars FROM k GROUP BY conv_id)
SELECT g.conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, (chars + coalesce(history, 0))::BIGINT AS formatted_chars FROM g LEFT JOIN h USING (conv_id)
"""
