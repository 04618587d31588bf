"""Results for people: highlighted parts, a statistics line, a debugging text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .tokenize import TYPES

_PART = "struct<text:string,is_highlighted:boolean>"


def highlights() -> Column:
    """array<struct<text, is_highlighted>> from a result's ``text`` and ``tokens``; a Kana prefix match lights its share only."""
    end = "if(t.is_prefix and t.type = 1, t.doc_start + greatest(1, int(floor((t.doc_end - t.doc_start) * least(1.0D, (t.in_end - t.in_start) / t.cp_len) + 0.5D))), t.doc_end)"
    part = lambda text, lit: f"cast(array(named_struct('text', {text}, 'is_highlighted', {lit})) as array<{_PART}>)"
    none = f"cast(array() as array<{_PART}>)"
    gap = "substring(text, acc.at + 1, greatest(0, t.doc_start - acc.at))"
    lit = f"substring(text, t.doc_start + 1, {end} - t.doc_start)"
    return F.expr(
        f"aggregate(tokens, cast(named_struct('at', 0, 'parts', {none}) as struct<at:int,parts:array<{_PART}>>), (acc, t) -> cast(named_struct('at', {end}, "
        f"'parts', concat(acc.parts, if({gap} <> '', {part(gap, 'false')}, {none}), {part(lit, 'true')})) as struct<at:int,parts:array<{_PART}>>), "
        f"acc -> concat(acc.parts, if(acc.at < length(text), {part('substring(text, acc.at + 1)', 'false')}, {none})))"
    )


def stats_line() -> Column:
    prefix = F.when(F.col("prefix_match_count") > 0, F.concat(F.col("prefix_match_count").cast("string"), F.lit(" prefix")))
    return F.concat_ws(", ", F.concat(F.col("range_count").cast("string"), F.lit(" range(s)")), F.concat(F.floor(F.col("match_ratio") * 100 + 0.5).cast("string"), F.lit("%")), prefix)


def _escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _quoted(c: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("s"))), r'(?s)^\{"s":(.*)\}$', 1)


def inspect(results: DataFrame, html: bool = False) -> DataFrame:
    """results with ``inspection``: the text, ranges, ratio and level, and a line for each token."""
    said = F.concat(F.lit(" ("), F.col("range_count"), F.lit(" ranges, "), F.regexp_replace(F.format_string("%.4f", F.col("match_ratio")), r"\.?0+$", ""), F.lit(" => L"), F.col("match_ratio_level"), F.lit(")"))
    code = (lambda c: F.concat(F.lit("<code>"), c, F.lit("</code>"))) if html else (lambda c: c)
    show = _escape if html else (lambda c: c)
    lit = F.array_join(F.transform(highlights(), lambda p: F.when(p["is_highlighted"], F.concat(F.lit("<u><b>"), _escape(p["text"]), F.lit("</b></u>"))).otherwise(_escape(p["text"]))), "")

    def line(t):
        name = F.element_at(F.array(*map(F.lit, TYPES)), t["type"] + 1)
        own = F.substring(F.col("text"), t["doc_start"] + 1, t["doc_end"] - t["doc_start"])
        tail = F.when(t["is_prefix"], F.lit(" (prefix match)")).otherwise(F.lit(""))
        return code(F.concat(F.lit("    "), name, F.lit(": "), show(_quoted(t["text"])), F.lit(" -> "), show(_quoted(own)), tail))

    head = F.concat(lit if html else _quoted(F.col("text")), code(said))
    return results.withColumn("inspection", F.array_join(F.concat(F.array(head), F.transform("tokens", line), F.array(F.lit(""))), "\n"))
