"""Fill-in-the-middle transformation by one counted-quantifier match a text; all of it is native SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A line with its end, or a last line without one.
LINE = r"[^\n]*\n|[^\n]+"
#: The same line taken whole or not at all, so that a match never gives a character back.
WHOLE_LINE = r"[^\n]*+\n|[^\n]++"

#: How the named parts, groups 1 (prefix), 2 (middle) and 3 (suffix) of the match, are put together.
ORDER = {"psm": f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", "spm": f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"}
#: The way back: the markers occur once each in a form that is not plain, and in this order.
BACK = {"psm": (f"(?s)\\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)\\z", "$1$3$2"), "spm": (f"(?s)\\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)\\z", "$2$3$1")}


def _draws(id_col: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a row: groups of the sha256 of `seed:id`. A null id counts as no text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def fill_in_middle(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """(id, n, form, output, prefix_chars, middle_chars): each text cut at two of its n lines' borders
    and put together anew as `form` says: `spm` for spm_rate percent of the texts, else `psm`; or `plain`, the text
    as it is, if it is empty, holds a marker, or falls beyond `rate` percent. All by hashes of the id.

    n is the count of the line pattern. One pattern a row then holds both places as counted
    possessive groups, (line){a}+ and (line){b - a}+; its single match gives all three parts, and the
    replacement puts them in order. Possessive groups are matched in a loop: no stack grows with a text's lines.
    Null texts count as empty; repeated rows give equal rows; rows of one id are cut by the same draws; a null
    id has draws of its own; other columns are not read, so their names don't matter; no rows give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col), text.alias("__text"), F.regexp_count(text, F.lit(LINE)).cast("bigint").alias("n"), F.array(*_draws(F.col(id_col), seed)).alias("__h"))
    h = lambda k: F.get("__h", F.lit(k))
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("__text", F.lit(m))
    one, two = (F.pmod(h(k), F.col("n") + 1) for k in (0, 1))
    placed = counted.select(
        id_col, "__text", "n",
        F.when((F.col("n") == 0) | marked | (F.pmod(h(2), F.lit(100)) >= rate), "plain").when(F.pmod(h(3), F.lit(100)) < spm_rate, "spm").otherwise("psm").alias("form"),
        F.least(one, two).alias("__a"), F.greatest(one, two).alias("__b"),
    )
    group = lambda n: F.concat(F.lit(f"((?:{WHOLE_LINE}){{"), n.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"(?s)\A"), group(F.col("__a")), group(F.col("__b") - F.col("__a")), F.lit(r"(.*)\z"))
    put = F.when(F.col("form") == "spm", ORDER["spm"]).otherwise(ORDER["psm"])
    out = placed.select(id_col, "n", "form", F.when(F.col("form") == "plain", F.col("__text")).otherwise(F.regexp_replace("__text", pattern, put)).alias("output"))
    at = lambda m: F.instr("output", m)
    prefix = F.when(F.col("form") == "psm", at(SUFFIX) - len(PREFIX) - 1).when(F.col("form") == "spm", at(MIDDLE) - at(PREFIX) - len(PREFIX))
    middle = F.when(F.col("form") != "plain", F.char_length("output") - at(MIDDLE) - len(MIDDLE) + 1)
    return out.select(id_col, "n", "form", "output", prefix.cast("bigint").alias("prefix_chars"), middle.cast("bigint").alias("middle_chars"))


def restore(form: Column, output: Column) -> Column:
    """The text that gave `output` in `form`, exactly."""
    back = F.when(form == "plain", output)
    for name, (pattern, put) in BACK.items():
        back = back.when(form == name, F.regexp_replace(output, pattern, put))
    return back
