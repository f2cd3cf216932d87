"""Chat formatting in budgeted windows. DataFrame functions only.

A conversation becomes one or more training texts of at most max_tokens
estimated tokens. Prefix sums of turn tokens choose where each window ends:
always between turns. Every window opens with the system turn (if the
conversation starts with one) and, from the second on, with a limited stretch
of the turns just before it; both are repeats, and the loss mask leaves them
out, so each assistant text is a target exactly once.

Template, one segment a turn:  <|turn|>ROLE\\nTEXT<|end|>\\n
ROLE is URL-encoded. In TEXT every backslash is doubled and a backslash is put
after the first character of each control string, so no text can open or
close a turn; unescape() reverses it exactly.

A turn over the budget is never cut: it makes a window of its own, and
over_budget says so. Null text or role: empty. Rows are ordered by (turn,
role, text), nulls first; repeated rows are repeated turns. A null conv_id is
a conversation. A conversation without rows has no window. Further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TOKENS = 1024
HISTORY_TOKENS = 256
HISTORY_TURNS = 2

# Strings that mark turns, here or in common chat templates.
_OPEN, _END = "<|turn|>", "<|end|>\n"
_CONTROL = r"(<|\[)(?=\||/?s>|/?INST\]|<SYS>>|</SYS>>)"
_ESCAPED = r"(<|\[)\\(?=\||/?s>|/?INST\]|<SYS>>|</SYS>>)"
_PIECE = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, _ESCAPED, "$1"), F.lit("\\\\"), F.lit("\\"))


def turn_tokens(text: Column) -> Column:
    """Estimated tokens: two for every three started characters of a word, one for any other piece; 4 for the marks."""
    pieces = F.regexp_count(text, F.lit(_PIECE))
    return (F.greatest(pieces, F.ceil(F.length(text) / 3).cast("int")) + 4).cast("long")


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    max_tokens: int = MAX_TOKENS,
    history_tokens: int = HISTORY_TOKENS,
    history_turns: int = HISTORY_TURNS,
) -> DataFrame:
    """conv_col, window, first_turn, n_repeated, n_turns, tokens, over_budget, formatted, loss_spans.

    loss_spans: (start, length) in code points of formatted, one for each new assistant text.
    """
    rows = turns.select(
        F.col(conv_col).alias("c"),
        F.col(turn_col).alias("n"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    body = escape(F.col("text"))
    rows = rows.select("c", "n", "role", "text", body.alias("body"), turn_tokens(F.col("text")).alias("tok"))
    head = F.concat(F.lit(_OPEN), F.url_encode("role"), F.lit("\n"))
    seg = F.struct("n", "role", "text", "tok", F.concat(head, "body", F.lit(_END)).alias("seg"), F.length(head).cast("long").alias("at"), F.length("body").cast("long").alias("len"))
    conv = rows.groupBy("c").agg(F.array_sort(F.collect_list(seg)).alias("raw"))
    # the texts were only needed as sort keys
    conv = conv.select("c", F.transform("raw", lambda x: F.struct(x["role"].alias("role"), x["tok"].alias("tok"), x["seg"].alias("seg"), x["at"].alias("at"), x["len"].alias("len"))).alias("all"))
    conv = conv.withColumn("n_sys", (F.element_at("all", 1)["role"] == "system").cast("int"))
    conv = conv.withColumn("sys", F.slice("all", F.lit(1), F.col("n_sys"))).withColumn("body", F.slice("all", F.col("n_sys") + 1, F.size("all") - F.col("n_sys")))
    sys_tok = F.aggregate("sys", F.lit(0).cast("bigint"), lambda s, x: s + x["tok"])
    conv = conv.withColumn("room", F.greatest(F.lit(max_tokens) - sys_tok - F.lit(history_tokens), F.lit(1)).cast("bigint")).withColumn("sys_tok", sys_tok)

    # a fold over the prefix sum: sum so far, sum where the open window began, turns so far, starts of windows
    empty = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).cast("bigint").alias("base"), F.lit(0).alias("i"), F.array(F.lit(0)).alias("starts"))

    def place(s: Column, x: Column) -> Column:
        opens = (s["sum"] + x["tok"] - s["base"] > F.col("room")) & (s["sum"] > s["base"])
        return F.struct(
            (s["sum"] + x["tok"]).alias("sum"),
            F.when(opens, s["sum"]).otherwise(s["base"]).alias("base"),
            (s["i"] + 1).alias("i"),
            F.when(opens, F.concat(s["starts"], F.array(s["i"]))).otherwise(s["starts"]).alias("starts"),
        )

    conv = conv.withColumn("starts", F.aggregate("body", empty, place, lambda s: s["starts"]))
    win = conv.select("*", F.posexplode("starts").alias("window", "s"))
    e = F.coalesce(F.try_element_at("starts", F.col("window") + 2), F.size("body"))
    win = win.withColumn("fresh", F.slice("body", F.col("s") + 1, e - F.col("s")))
    # history: the longest stretch of the last history_turns turns whose tokens fit
    lo = F.greatest(F.col("s") - F.lit(history_turns), F.lit(0))
    win = win.withColumn("recent", F.reverse(F.slice("body", lo + 1, F.col("s") - lo)))
    none = F.struct(F.lit(0).cast("bigint").alias("tok"), F.lit(0).alias("n"), F.lit(True).alias("open"))
    fits = F.aggregate(
        "recent",
        none,
        lambda a, x: F.struct(
            (a["tok"] + x["tok"]).alias("tok"),
            (a["n"] + (a["open"] & (a["tok"] + x["tok"] <= history_tokens)).cast("int")).alias("n"),
            (a["open"] & (a["tok"] + x["tok"] <= history_tokens)).alias("open"),
        ),
        lambda a: a["n"],
    )
    win = win.withColumn("hist", F.reverse(F.slice("recent", F.lit(1), fits)))
    win = win.withColumn("lead", F.when(F.col("window") == 0, F.array().cast(win.schema["sys"].dataType)).otherwise(F.concat("sys", "hist")))
    win = win.withColumn("new", F.when(F.col("window") == 0, F.concat("sys", "fresh")).otherwise(F.col("fresh")))
    text = F.array_join(F.transform(F.concat("lead", "new"), lambda x: x["seg"]), "")
    lead_len = F.aggregate("lead", F.lit(0).cast("bigint"), lambda s, x: s + F.length(x["seg"]))
    spans = F.aggregate(
        "new",
        F.struct(lead_len.alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["seg"])).alias("at"),
            F.when(x["role"] == "assistant", F.concat(s["spans"], F.array(F.struct((s["at"] + x["at"]).alias("start"), x["len"].alias("length"))))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    tokens = F.aggregate(F.concat("lead", "new"), F.lit(0).cast("bigint"), lambda s, x: s + x["tok"])
    return win.select(
        F.col("c").alias(conv_col),
        "window",
        (F.col("s") + F.when(F.col("window") == 0, F.lit(0)).otherwise(F.col("n_sys"))).alias("first_turn"),
        F.size("lead").alias("n_repeated"),
        F.size("new").alias("n_turns"),
        tokens.alias("tokens"),
        (tokens > max_tokens).alias("over_budget"),
        text.alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digests of what the formatted windows say, one row a conversation."""
    segs = F.filter(F.split("formatted", r"<\|end\|>\n", -1), lambda x: x != "")
    fresh = F.slice(segs, F.col("n_repeated") + 1, F.greatest(F.size(segs) - F.col("n_repeated"), F.lit(0)))
    bare = F.transform(fresh, lambda x: F.substring(x, len(_OPEN) + 1, F.length(x)))
    told = F.transform(
        bare,
        lambda x: F.concat(
            F.url_decode(F.substring_index(x, "\n", 1)), F.lit("\n"), unescape(F.substring(x, F.instr(x, "\n") + 1, F.length(x))), F.lit("\n")
        ),
    )
    loss = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"].cast("int") + 1, s["length"].cast("int"))))
    parts = windows.select(
        conv_col, "window", F.size(fresh).cast("long").alias("n"), F.array_join(told, "").alias("told"), F.array_join(loss, "").alias("loss"), F.length("formatted").cast("long").alias("chars")
    )
    whole = parts.groupBy(conv_col).agg(
        F.array_sort(F.collect_list(F.struct("window", "told", "loss"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows")
    )
    said = F.array_join(F.transform("w", lambda x: x["told"]), "")
    target = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return whole.select(
        conv_col,
        "n_turns",
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(target).cast("long").alias("loss_chars"),
        F.sha2(target, 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )
