"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example: all turns before it are context (``prompt``), its escaped
text is the only trainable part (``target``), ``suffix`` closes the turn. If a conversation doesn't
end with an assistant turn, a last example without target (``trainable`` false) carries the whole
conversation, so that no turn is lost.

A turn is written ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. In roles and texts ``&``, ``<`` and ``[``
become ``&amp;``, ``&lt;`` and ``&#91;`` (in roles also the line feed: ``&#10;``), so neither these
markers nor other control strings (``</s>``, ``[INST]``) can occur in them; ``unescape`` undoes it.

``prompt_chars`` comes from running lengths, so a plan that needs no prompts doesn't build them: they
are quadratic in the turns. A conversation's turns meet in one row, as its prompts need them.

Defined cases: null text or role: empty; order: turn (nulls first), then role and text for ties;
repeated rows are turns of their own; a null id is one conversation; an empty table gives no rows;
other columns are not carried, an example is made of several rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, ANSWERS = "<|im_start|>", "<|im_end|>\n", "assistant"


def escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")):
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out


def unescape(text: Column) -> Column:
    out = text
    for plain, coded in (("[", "&#91;"), ("<", "&lt;"), ("&", "&amp;")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def format_conversations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per example: conv_id, example (turns before the target), trainable, last, prompt,
    target, suffix, prompt_chars, target_chars."""
    turns = conversations.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    whole = whole.select(
        "conv_id",
        F.transform("ts", lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))).alias("heads"),
        F.transform("ts", lambda t: escape(t["text"])).alias("bodies"),
        F.transform("ts", lambda t: t["role"] == ANSWERS).alias("answers"),
    )
    n = F.size("bodies")
    lengths = F.zip_with("heads", "bodies", lambda h, b: (F.length(h) + F.length(b) + len(END)).cast("long"))
    at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.element_at("answers", i + 1))
    whole = whole.select("conv_id", "heads", "bodies", lengths.alias("lengths"), F.when(F.element_at("answers", -1), at).otherwise(F.concat(at, F.array(n))).alias("at"))
    rows = whole.select("*", F.explode("at").alias("example"))
    trainable = F.col("example") < F.size("bodies")
    before = F.zip_with(F.slice("heads", 1, F.col("example")), F.slice("bodies", 1, F.col("example")), lambda h, b: F.concat(h, b, F.lit(END)))
    own = F.col("example") + 1
    return rows.select(
        "conv_id",
        "example",
        trainable.alias("trainable"),
        (F.col("example") >= F.size("bodies") - 1).alias("last"),
        F.concat(F.array_join(before, ""), F.when(trainable, F.element_at("heads", own)).otherwise(F.lit(""))).alias("prompt"),
        F.when(trainable, F.element_at("bodies", own)).alias("target"),
        F.when(trainable, F.lit(END)).otherwise(F.lit("")).alias("suffix"),
        (F.aggregate(F.slice("lengths", 1, F.col("example")), F.lit(0).cast("long"), lambda a, x: a + x) + F.when(trainable, F.length(F.element_at("heads", own))).otherwise(F.lit(0))).alias("prompt_chars"),
        F.coalesce(F.when(trainable, F.length(F.element_at("bodies", own))), F.lit(0)).cast("long").alias("target_chars"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the formatted output alone: the turns of the last example and the text
    under the loss masks."""
    whole = F.when(F.col("last"), F.concat("prompt", F.coalesce("target", F.lit("")), "suffix"))
    per = examples.groupBy("conv_id").agg(
        F.max(whole).alias("whole"),
        F.sort_array(F.collect_list(F.when(F.col("trainable"), F.struct("example", "target")))).alias("targets"),
        F.sum(F.col("prompt_chars") + F.col("target_chars") + F.length("suffix")).cast("long").alias("formatted_chars"),
    )
    raw = F.filter(F.split(F.replace(F.col("whole"), F.lit(START), F.lit("")), r"<\|im_end\|>\n"), lambda x: x != "")
    turns = F.transform(raw, lambda x: F.concat(unescape_role(F.substring_index(x, "\n", 1)), F.lit("\n"), unescape(F.substring(x, F.locate("\n", x) + 1, F.length(x))), F.lit("\n")))
    per = per.select("conv_id", turns.alias("turns"), F.array_join(F.transform("targets", lambda t: unescape(t["target"])), "").alias("loss"), "formatted_chars")
    return per.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
