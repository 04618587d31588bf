"""Search: the best chain of token spans in every document, ranked.

Matches (few rows, found at once) are sent to the postings, which aren't shuffled; what they meet is grouped by (query, document), the one shuffle before
ranking. A fold over a document's edges, in the order of their query position, keeps one state for each (query end, document end), the best by ranges, first
start, last span and matched length; ties stay with what came first. The states at the query's end give the document's result.

Documents of up to ``LONG`` code points are folded inside the row, in the JVM, in time that grows with the square of their length; longer ones by ``best_chain``, the
same recurrence over sorted states with running minima, in about linear time. Both give the same results; no document is too long.

Defined results: null and blank queries find nothing; an index has one row for a document; columns of queries besides query_id and query are ignored; an
empty index finds nothing.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.storage import scratch_path, stored
from .index import Index
from .match import edges

LONG = 512
#: Matches that are broadcast to the postings; more are joined by a shuffle.
SENT = 200_000

TOKEN = "struct<token_id:bigint,type:int,text:string,cp_len:int,doc_start:int,doc_end:int,in_start:int,in_end:int,is_prefix:boolean>"
_EDGE = "struct<l:int,r:int,rank:int,token_id:bigint,st:int,en:int,type:int,text:string,cp_len:int,is_prefix:boolean,gain:double>"
_STATE = f"struct<ranges:int,first:int,st:int,en:int,minus:double,before:int,r:int,prefixes:int,last_prefix:boolean,tokens:array<{TOKEN}>>"

#: One step of the fold: the best state that an edge can end, put in unless one as good is there already.
_FOLD = f"""
aggregate(edges, cast(array() as array<{_STATE}>), (acc, e) -> concat(
  filter(acc, s -> not (s.r = e.r and s.en = e.en)),
  transform(
    slice(array_sort(concat(
      transform(filter(acc, s -> s.r = e.r and s.en = e.en), s -> named_struct('s', s, 'late', 0)),
      if(e.l = 0, array(named_struct('s', cast(named_struct('ranges', 1, 'first', e.st, 'st', e.st, 'en', e.en, 'minus', -e.gain, 'before', -1, 'r', e.r,
          'prefixes', int(e.is_prefix), 'last_prefix', e.is_prefix and e.type not in (1, 2), 'tokens', array(named_struct('token_id', e.token_id, 'type', e.type, 'text', e.text,
          'cp_len', e.cp_len, 'doc_start', e.st, 'doc_end', e.en, 'in_start', e.l, 'in_end', e.r + 1, 'is_prefix', e.is_prefix))) as {_STATE}), 'late', 1)),
        transform(filter(acc, s -> s.r = e.l - 1 and s.en <= e.st), s -> named_struct('s', cast(named_struct(
          'ranges', s.ranges + int(solid[e.st] > solid[s.en]), 'first', s.first, 'st', e.st, 'en', e.en, 'minus', s.minus - e.gain, 'before', s.en, 'r', e.r,
          'prefixes', s.prefixes + int(e.is_prefix), 'last_prefix', e.is_prefix and e.type not in (1, 2), 'tokens', concat(s.tokens, array(named_struct('token_id', e.token_id,
          'type', e.type, 'text', e.text, 'cp_len', e.cp_len, 'doc_start', e.st, 'doc_end', e.en, 'in_start', e.l, 'in_end', e.r + 1, 'is_prefix', e.is_prefix)))) as {_STATE}), 'late', 1)))
    ), (x, y) -> case
      when x.s.ranges <> y.s.ranges then x.s.ranges - y.s.ranges when x.s.first <> y.s.first then x.s.first - y.s.first
      when x.s.st <> y.s.st then x.s.st - y.s.st when x.s.minus < y.s.minus then -1 when x.s.minus > y.s.minus then 1
      when x.late <> y.late then x.late - y.late else x.s.before - y.s.before end), 1, 1), x -> x.s)))
"""


def best_chain(edges, solid: list[int], n: int):
    """What ``_FOLD`` and ``_BEST`` give, for one document: edges sorted, n: the query's length."""
    if not edges:
        return None
    # by query end: states by document end, each (ranges, first, st, minus, en, before, prefixes, last_prefix, token, state before)
    ends: list[dict[int, tuple]] = [{} for _ in range(n)]
    sorted_: dict[int, tuple[list[int], list[tuple]]] = {}

    def settled(r: int):
        """Document ends of the states at r, and the best (ranges, first, minus, before, state) up to each; r has all of its states."""
        if r not in sorted_:
            at, least, best = sorted(ends[r]), [], None
            for en in at:
                s = ends[r][en]
                own = (s[0], s[1], s[3], en, s)
                if best is None or own[:4] < best[:4]:
                    best = own
                least.append(best)
            sorted_[r] = (at, least)
        return sorted_[r]

    for e in edges:
        l, r, st, en = e["l"], e["r"], e["st"], e["en"]
        if l == 0:
            found = (1, st, -e["gain"], -1, None)
        else:
            at, least = settled(l - 1)
            high = bisect_right(at, st)
            if not high:
                continue
            # states with nothing visible between them and the edge go on with their range
            low = bisect_left(at, bisect_left(solid, solid[st]), 0, high)
            ways = [(s[0], s[1], s[3] - e["gain"], k, s) for k, s in ((k, ends[l - 1][k]) for k in at[low:high])]
            if low:
                ranges, first, minus, k, s = least[low - 1]
                ways.append((ranges + 1, first, minus - e["gain"], k, s))
            found = min(ways, key=lambda w: w[:4])
        ranges, first, minus, before, old = found
        have = ends[r].get(en)
        if have is None or (ranges, first, st, minus) < have[:4]:
            last = bool(e["is_prefix"]) and e["type"] not in (1, 2)
            ends[r][en] = (ranges, first, st, minus, en, before, (old[6] if old else 0) + int(e["is_prefix"]), last, e, old)
    if not ends[n - 1]:
        return None
    s = min(ends[n - 1].values(), key=lambda s: (s[7], s[0], s[1], s[2], s[4]))
    tokens, at = [], s
    while at is not None:
        e = at[8]
        tokens.append({"token_id": e["token_id"], "type": e["type"], "text": e["text"], "cp_len": e["cp_len"], "doc_start": e["st"], "doc_end": e["en"], "in_start": e["l"], "in_end": e["r"] + 1, "is_prefix": e["is_prefix"]})
        at = at[9]
    return {"last_prefix": s[7], "ranges": s[0], "first": s[1], "st": s[2], "en": s[4], "minus": s[3], "prefixes": s[6], "tokens": tokens[::-1]}


_RESULT = f"struct<last_prefix:boolean,ranges:int,first:int,st:int,en:int,minus:double,prefixes:int,tokens:array<{TOKEN}>>"
_BEST = "array_min(transform(filter(states, s -> s.r = n - 1), s -> named_struct('last_prefix', s.last_prefix, 'ranges', s.ranges, 'first', s.first, 'st', s.st, 'en', s.en, 'minus', s.minus, 'prefixes', s.prefixes, 'tokens', s.tokens)))"


def matches(index: Index, queries: DataFrame, where: Column | None = None, allowed: DataFrame | None = None, trim: bool = False, long_vowel_at_end: bool = False) -> DataFrame:
    """Edges with the places they have: (query_id, doc_id, n, edges). where: a condition on doc_id, pushed to the postings."""
    found = stored(edges(index, queries, trim, long_vowel_at_end), scratch_path(index.spark, "edges"))
    if found.limit(SENT + 1).count() <= SENT:
        found = F.broadcast(found)
    places = index.postings
    if where is not None:
        places = places.where(where)
    if allowed is not None:
        places = places.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = places.join(found, "token_id").withColumn("o", F.explode("offsets"))
    size = F.col("o.end") - F.col("o.start")
    share = F.when(F.col("is_prefix"), F.least(F.lit(1.0), (F.col("r") - F.col("l") + 1) / F.col("cp_len"))).otherwise(F.lit(1.0))
    edge = F.struct("l", "r", "rank", "token_id", F.col("o.start").alias("st"), F.col("o.end").alias("en"), "type", "text", "cp_len", "is_prefix", (size * share).alias("gain"))
    rows = rows.groupBy("query_id", "doc_id", "n").agg(F.sort_array(F.collect_list(edge)).cast(f"array<{_EDGE}>").alias("edges"))
    # a result needs an edge that begins the query and one that ends it
    return rows.where("exists(edges, e -> e.l = 0) and exists(edges, e -> e.r = n - 1)")


def search(
    index: Index,
    queries: DataFrame | str,
    k: int | None = None,
    where: Column | None = None,
    allowed: DataFrame | None = None,
    order_by: list[Column] | None = None,
    trim: bool = False,
    long_vowel_at_end: bool = False,
    long: int = LONG,
) -> DataFrame:
    """(query_id, rank, doc_id, text, range_count, prefix_match_count, match_ratio, match_ratio_level, tokens).

    queries: (query_id, query), or one query. where, allowed: documents to search, by a condition on doc_id or a table of ids. order_by:
    columns of documents that break ties instead of the text. k: so many results for each query. long: from how many code points on documents are
    folded in Python.
    """
    if isinstance(queries, str):
        queries = index.spark.createDataFrame([(0, queries)], "query_id long, query string")
    docs = index.documents.withColumn("cps", F.length("text"))
    met = matches(index, queries, where, allowed, trim, long_vowel_at_end)
    rows = met.join(docs.where(F.col("cps") <= long), "doc_id")
    rows = rows.withColumn("states", F.expr(_FOLD)).withColumn("b", F.expr(_BEST).cast(_RESULT)).drop("states", "edges", "solid", "n")
    if index.longest is None or index.longest > long:
        chain = F.udf(best_chain, _RESULT, useArrow=True)
        more = met.join(docs.where(F.col("cps") > long), "doc_id")
        rows = rows.unionByName(more.withColumn("b", chain("edges", "solid", "n")).drop("edges", "solid", "n"))
    # gains add up to integers and fractions of them alike in any engine once rounded far below a code point
    rows = rows.where("b is not null").withColumn("ratio", -F.col("b.minus") / F.col("cps"))
    rows = rows.withColumn("level", F.floor(F.col("ratio") * 5 + 0.5).cast("int"))
    keys = [F.col("b.last_prefix"), F.col("b.ranges"), F.col("b.first"), F.desc("level"), F.col("b.st"), F.col("b.en"), F.desc("ratio")]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*keys, *(order_by or [F.col("text")]), "doc_id"))
    out = rows.withColumn("rank", rank)
    if k is not None:
        out = out.where(F.col("rank") <= k)
    return out.select(
        "query_id", "rank", "doc_id", "text", F.col("b.ranges").alias("range_count"), F.col("b.prefixes").alias("prefix_match_count"), F.col("ratio").alias("match_ratio"), F.col("level").alias("match_ratio_level"), F.col("b.tokens").alias("tokens")
    )
