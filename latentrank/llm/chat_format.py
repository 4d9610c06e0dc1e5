"""Chat formatting in budgeted, turn-aligned windows (DataFrame functions only).

Prefix sums of the turns' tokens cut a conversation into spans of whole turns: a
span begins with the first turn that the span before has no room for, and takes
turns as long as their tokens fit into the stride.  The stride is the budget
less the leading system turn and the history, at least ``min_stride``; only a
single turn longer than the stride makes a longer span.  Every window holds the
leading system turn, then as many of the last turns before its span as fit into
the history and into what lead and span leave of the budget, then the span's own
turns.  So a window exceeds the budget only by a single turn, or a leading one,
that is too long for it.  Repeated turns are marked as such and are never under
the loss mask, so each assistant text is a target once.

A conversation is sorted, cut and formatted in one row, as its digest needs it
in one anyway; conversations are dealt over all tasks by one exchange.

Template: ``<turn role="ROLE">TEXT</turn>`` and a line feed; repeated turns have
``<turn role="ROLE" repeated>``.  Inside roles and texts ``\\`` becomes ``\\b``,
``<`` becomes ``\\l`` and ``"`` becomes ``\\q``, which is reversible and leaves no
control string in a text.

Rows are ordered by turn (null first), then role, then text, so ties and
repeated rows have a fixed place and all stay.  Null texts and roles are empty;
rows with a null conversation id form one conversation; an empty table gives an
empty table; extra columns are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WORD, plain

BUDGET, HISTORY, MIN_STRIDE, TURN_TOKENS = 1024, 256, 128, 4
#: Starts of spans in a block of the list of starts.
STARTS = 256
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ('"', "\\q"))


def escape(c: Column) -> Column:
    for plain_text, code in ESCAPES:
        c = F.replace(c, F.lit(plain_text), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain_text, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain_text))
    return c


def format_windows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", *, budget: int = BUDGET, history: int = HISTORY, min_stride: int = MIN_STRIDE) -> DataFrame:
    """Windows: ``conv_col``, window (long), formatted (string), loss
    (array<struct<start, length>>, code points from 0), n_tokens (long)."""
    rows = plain(conversations, conv_col, turn_col, role_col, text_col).toDF("c", "turn", "role", "text").select("c", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", (F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))) + TURN_TOKENS).cast("bigint"))
    talks = rows.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "tokens"))).alias("all"))
    lead = F.when(F.col("all")[0]["role"] == "system", 1).otherwise(0)
    talks = talks.select("c", "all", lead.alias("lead"), (lead * F.col("all")[0]["tokens"]).cast("bigint").alias("lead_tokens"))
    talks = talks.withColumn("stride", F.greatest(F.lit(budget - history) - F.col("lead_tokens"), F.lit(min_stride)))
    # places of the turns at which spans begin, from 1; tokens are summed along the turns.
    # Starts are gathered in blocks, as adding to one long list would copy it each time.
    kept = lambda at, total: F.struct((at["i"] + 1).alias("i"), total.alias("sum"), at["recent"].alias("recent"), at["done"].alias("done"))
    fresh = lambda at: F.array(at["i"] + 1)
    spans = F.aggregate(
        F.transform("all", lambda t: t["tokens"]),
        F.struct(F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<int>").alias("recent"), F.array().cast("array<array<int>>").alias("done")),
        lambda at, n: F.when(at["i"] < F.col("lead"), kept(at, at["sum"]))
        .when((F.size(at["recent"]) > 0) & (at["sum"] + n <= F.col("stride")), kept(at, at["sum"] + n))
        .when(F.size(at["recent"]) < STARTS, F.struct((at["i"] + 1).alias("i"), n.alias("sum"), F.concat(at["recent"], fresh(at)).alias("recent"), at["done"].alias("done")))
        .otherwise(F.struct((at["i"] + 1).alias("i"), n.alias("sum"), fresh(at).alias("recent"), F.concat(at["done"], F.array(at["recent"])).alias("done"))),
        lambda at: F.flatten(F.concat(at["done"], F.array(at["recent"]))),
    )
    # a leading system turn alone is a window too
    talks = talks.withColumn("starts", F.when(F.size(spans) > 0, spans).otherwise(F.array(F.lit(2))))
    total = lambda turns: F.aggregate(F.transform(turns, lambda t: t["tokens"]), F.lit(0).cast("bigint"), lambda a, n: a + n)

    def turns_of(start, end):
        """Turns from ``start`` to before ``end``, by their places: a slice would copy the whole conversation first."""
        return F.when(start < end, F.transform(F.sequence(start, end - 1), lambda i: F.get("all", i - 1))).otherwise(F.slice("all", 1, 0))

    def window_of(start, w):
        end = F.coalesce(F.get("starts", w + 1), F.size("all") + 1)
        before = F.greatest(start - history // TURN_TOKENS, F.col("lead") + 1)
        return F.struct(w.alias("window"), turns_of(start, end).alias("own"), turns_of(before, start).alias("earlier"))

    # the opener is taken before, so that no window carries the whole conversation
    talks = talks.withColumn("first", F.col("all")[0])
    cut = talks.select("c", "lead", "lead_tokens", "first", F.explode(F.transform("starts", window_of)).alias("w")).select("c", "lead", "lead_tokens", "first", "w.*")
    cut = cut.withColumn("room", F.least(F.lit(history).cast("bigint"), F.lit(budget) - F.col("lead_tokens") - total("own")))
    # the last earlier turns whose tokens together fit into the room
    fit = F.aggregate(
        F.reverse(F.transform("earlier", lambda t: t["tokens"])), F.struct(F.lit(0).alias("n"), F.col("room").alias("left")),
        lambda at, n: F.when(n <= at["left"], F.struct((at["n"] + 1).alias("n"), (at["left"] - n).alias("left"))).otherwise(F.struct(at["n"].alias("n"), F.lit(-1).cast("bigint").alias("left"))),
        lambda at: at["n"],
    )
    cut = cut.withColumn("history", F.slice("earlier", F.size("earlier") - fit + 1, fit))
    said = lambda turns, repeated: F.transform(turns, lambda t: F.struct(F.lit(repeated).alias("repeated"), t["role"].alias("role"), t["text"].alias("text"), t["tokens"].alias("tokens")))
    opener = F.when(F.col("lead") == 1, F.array(F.struct((F.col("window") > 0).alias("repeated"), F.col("first.role").alias("role"), F.col("first.text").alias("text"), F.col("first.tokens").alias("tokens"))))
    turns = F.concat(F.coalesce(opener, F.array().cast("array<struct<repeated:boolean,role:string,text:string,tokens:bigint>>")), said("history", True), said("own", False))
    closing = "</turn>\n"
    opening = lambda s: F.concat(F.lit('<turn role="'), escape(s["role"]), F.when(s["repeated"], F.lit('" repeated>')).otherwise(F.lit('">')))
    parts = F.transform(turns, lambda s: F.struct(opening(s).alias("open"), escape(s["text"]).alias("body"), (~s["repeated"] & (s["role"] == "assistant")).alias("target"), s["tokens"].alias("tokens")))
    windows = cut.select("c", "window", parts.alias("parts"))
    empty = F.array().cast("array<struct<start:int,length:int>>")
    step = lambda a, s: F.struct(
        (a["at"] + F.length(s["open"]) + F.length(s["body"]) + len(closing)).alias("at"),
        F.when(s["target"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(s["open"])).alias("start"), F.length(s["body"]).alias("length"))))).otherwise(a["spans"]).alias("spans"),
    )
    loss = F.aggregate("parts", F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda a: a["spans"])
    text = F.array_join(F.transform("parts", lambda s: F.concat(s["open"], s["body"], F.lit(closing))), "")
    return windows.select(F.col("c").alias(conv_col), F.col("window").cast("bigint").alias("window"), text.alias("formatted"), loss.alias("loss"), total("parts").alias("n_tokens"))


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digests of what the windows say: turns that are not repeated, and the text under the loss mask."""
    turn = F.lit('<turn role="([^"<]*)">([^<]*)</turn>\n')
    found = windows.select(
        conv_col, "window", F.length("formatted").cast("bigint").alias("size"),
        F.arrays_zip(F.regexp_extract_all("formatted", turn, F.lit(1)).alias("role"), F.regexp_extract_all("formatted", turn, F.lit(2)).alias("body")).alias("turns"),
        unescape(F.array_join(F.transform("loss", lambda s: F.substring(F.col("formatted"), s["start"] + 1, s["length"])), "")).alias("target"),
    )
    turns = F.array_join(F.transform("turns", lambda t: F.concat(unescape(t["role"]), F.lit("\n"), unescape(t["body"]), F.lit("\n"))), "")
    per = found.select(conv_col, "window", "size", "target", F.size("turns").cast("bigint").alias("n"), turns.alias("said"))
    whole = per.groupBy(conv_col).agg(F.sum("n").alias("n_turns"), F.sum("size").alias("formatted_chars"), F.count("*").alias("n_windows"), F.sort_array(F.collect_list(F.struct("window", "said", "target"))).alias("all"))
    said, target = (F.array_join(f"all.{k}", "") for k in ("said", "target"))
    return whole.select(conv_col, "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(target).cast("bigint").alias("loss_chars"), F.sha2(target, 256).alias("loss_sha256"), "formatted_chars", "n_windows")


#: The same in DuckDB over the table ``conversations`` and the two planted rows.
SQL = rf"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
rows AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + {TURN_TOKENS} AS tokens,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM source),
marked AS (
  SELECT *, pos = 1 AND role = 'system' AS lead,
    12 + 2 + 8 + length(role) + length(text)
    + length(role) * 2 - length(replace(role, '\', '')) - length(replace(role, '<', ''))
    + length(text) * 2 - length(replace(text, '\', '')) - length(replace(text, '<', ''))
    + length(role) - length(replace(role, '"', '')) + length(text) - length(replace(text, '"', '')) AS size
  FROM rows),
sums AS (
  SELECT *, sum(CASE WHEN lead THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS lead_tokens,
    sum(CASE WHEN lead THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY pos) - CASE WHEN lead THEN 0 ELSE tokens END AS before
  FROM marked),
filled AS (
  SELECT conv_id, pos, CASE WHEN lead THEN 0 ELSE tokens END AS held, 0::BIGINT AS win, lead AS fresh FROM sums WHERE pos = 1
  UNION ALL
  SELECT s.conv_id, s.pos,
    CASE WHEN f.fresh OR f.held + s.tokens <= greatest({BUDGET - HISTORY} - s.lead_tokens, {MIN_STRIDE}) THEN f.held + s.tokens ELSE s.tokens END,
    CASE WHEN f.fresh OR f.held + s.tokens <= greatest({BUDGET - HISTORY} - s.lead_tokens, {MIN_STRIDE}) THEN f.win ELSE f.win + 1 END, false
  FROM filled f JOIN sums s ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND s.pos = f.pos + 1),
placed AS (SELECT s.*, f.win FROM sums s JOIN filled f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND s.pos = f.pos),
windows AS (
  SELECT conv_id, win, min(before) FILTER (NOT lead) AS start,
    least({HISTORY}, {BUDGET} - min(lead_tokens) - coalesce(sum(tokens) FILTER (NOT lead), 0)) AS room
  FROM placed GROUP BY conv_id, win),
repeats AS (
  SELECT p.conv_id, sum(size + 9) AS size FROM placed p JOIN windows w ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND NOT p.lead AND p.win < w.win AND w.start - p.before <= w.room
  GROUP BY p.conv_id)
SELECT p.conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '')) AS loss_sha256,
  (sum(p.size) + coalesce(sum(CASE WHEN lead THEN p.size + 9 END), 0) * max(win) + coalesce(max(r.size), 0))::BIGINT AS formatted_chars,
  (max(win) + 1)::BIGINT AS n_windows
FROM placed p LEFT JOIN repeats r ON p.conv_id IS NOT DISTINCT FROM r.conv_id GROUP BY p.conv_id
"""
