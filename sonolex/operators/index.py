"""The index: four tables, built once, stored, loaded and exported.

documents (doc_id, text, solid); tokens (token_id, type, text, cp_len, trie); postings (token_id, doc_id, offsets), sorted by token;
token_prefixes (trie, prefix, token_id, is_exact). Token ids number the dictionary by (type, text). ``solid[i]`` is the number of visible code points before
place i of a document.

Defined results: documents need one row for each id, or building fails; a null text counts as empty, and an empty one is never found; other columns
are ignored; an empty table gives an empty index.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import text as T
from ..sources.dictionaries import Dictionaries
from ..sources.storage import numbered, scratch_path, stored
from .tokenize import KANA, ROMAJI, tokenize

TABLES = ("tokens", "postings", "token_prefixes")


def trie_of(kind: Column) -> Column:
    return F.when(kind == ROMAJI, "romaji").when(kind == KANA, "kana").otherwise("other")


def dictionary(occurrences: DataFrame) -> DataFrame:
    """Distinct (type, text) with dense ids in their order."""
    rows = numbered(occurrences.select("type", "text").distinct(), "token_id", "type", "text")
    return rows.select("token_id", "type", "text", F.length("text").alias("cp_len"), trie_of(F.col("type")).alias("trie"))


def postings(occurrences: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token_id, doc_id, offsets): where a token stands in a document, in the order of emission."""
    rows = occurrences.join(tokens.select("token_id", "type", "text"), ["type", "text"])
    spans = F.sort_array(F.collect_list(F.struct("seq", "start", "end")))
    rows = rows.groupBy("token_id", "doc_id").agg(spans.alias("s"))
    return rows.select("token_id", "doc_id", F.transform("s", lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"))).alias("offsets"))


def prefixes(tokens: DataFrame) -> DataFrame:
    rows = tokens.select("trie", "text", "token_id", F.explode(F.sequence(F.lit(1), "cp_len")).alias("n"))
    return rows.select("trie", F.expr("substring(text, 1, n)").alias("prefix"), "token_id", (F.col("n") == F.length("text")).alias("is_exact"))


#: White space as the search defines it.
_BLANK = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]


def _solid(texts: pd.Series) -> pd.Series:
    blank = np.array(_BLANK, np.uint32)
    return texts.map(lambda t: np.concatenate([[0], np.cumsum(~np.isin(np.frombuffer((t or "").encode("utf-32-le"), "<u4"), blank))]).astype(np.int32))


@dataclass
class Index:
    tokens: DataFrame
    postings: DataFrame
    token_prefixes: DataFrame
    documents: DataFrame | None
    longest: int | None = field(default=None)  # code points of the longest document, if known
    tries: tuple[str, ...] = ("romaji", "kana", "other")  # those that hold tokens, as far as known

    @property
    def spark(self) -> SparkSession:
        return self.tokens.sparkSession

    def cache(self) -> Index:
        for df in (self.tokens, self.postings, self.token_prefixes, self.documents):
            if df is not None:
                df.cache()
        return self

    def write(self, path: str, bundle_documents: bool = True) -> None:
        """Postings are sorted by token inside files, so a search reads few row groups."""
        self.tokens.write.mode("overwrite").parquet(f"{path}/tokens")
        self.postings.repartition("token_id").sortWithinPartitions("token_id", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.token_prefixes.write.mode("overwrite").partitionBy("trie").parquet(f"{path}/token_prefixes")
        names = list(TABLES)
        if bundle_documents and self.documents is not None:
            self.documents.write.mode("overwrite").parquet(f"{path}/documents")
            names.append("documents")
        _manifest(self.spark, path, names, self.longest, self.tries)

    def to_json(self) -> DataFrame:
        """One JSON record for each token: id, type, text and postings as [doc, start, end, start, end, ...]. (``export_json`` has the whole in one.)"""
        flat = F.concat(F.array("doc_id"), F.flatten(F.transform("offsets", lambda o: F.array(o["start"].cast("long"), o["end"].cast("long")))))
        refs = self.postings.groupBy("token_id").agg(F.sort_array(F.collect_list(flat)).alias("tokenReferences"))
        rows = self.tokens.join(refs, "token_id", "left")
        return rows.select("token_id", F.to_json(F.struct(F.col("token_id").alias("tokenId"), F.col("type").alias("tokenType"), "text", "tokenReferences")).alias("json"))


def _manifest(spark: SparkSession, path: str, names, longest: int | None, tries) -> None:
    rows = [(n, longest, list(tries)) for n in names]
    spark.createDataFrame(rows, "name string, longest int, tries array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def bundled(documents: DataFrame) -> DataFrame:
    """documents as the index keeps them."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("solid", F.pandas_udf(_solid, ArrayType(IntegerType()))("text"))


def build(documents: DataFrame, dictionaries: Dictionaries | None = None, path: str | None = None) -> Index:
    """documents (doc_id, text) -> the index, stored at path (else in the shared folder). Texts are tokenised once."""
    spark = documents.sparkSession
    path = path or scratch_path(spark, "index")
    docs = stored(bundled(documents), f"{path}/documents")
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).collect()
    if odd:
        raise ValueError(f"documents need one row for each id; {odd[0]['doc_id']} has {odd[0]['n']}")
    occurrences = stored(tokenize(docs, dictionaries), f"{path}/occurrences")
    tokens = stored(dictionary(occurrences), f"{path}/tokens")
    found = postings(occurrences, tokens)
    stored(found.repartition("token_id").sortWithinPartitions("token_id", "doc_id"), f"{path}/postings")
    prefixes(tokens).write.mode("overwrite").partitionBy("trie").parquet(f"{path}/token_prefixes")
    longest = docs.agg(F.max(F.length("text"))).first()[0]
    _manifest(spark, path, (*TABLES, "documents"), longest, sorted(r["trie"] for r in tokens.select("trie").distinct().collect()))
    return load(spark, path)


def _prefix_table(spark: SparkSession, path: str) -> DataFrame:
    # the schema is given, as an empty index has no files to show it
    return spark.read.schema("prefix string, token_id long, is_exact boolean, trie string").parquet(f"{path}/token_prefixes")


def load(spark: SparkSession, path: str, documents: DataFrame | None = None) -> Index:
    """An index that was written; documents must come with it or be given."""
    manifest = {r["name"]: r for r in spark.read.parquet(f"{path}/manifest").collect()}
    longest, tries = manifest["tokens"]["longest"], tuple(manifest["tokens"]["tries"])
    if documents is not None:
        documents, longest = documents if "solid" in documents.columns else bundled(documents), None
    elif "documents" not in manifest:
        raise ValueError("the index holds no documents; pass them to load()")
    else:
        documents = spark.read.parquet(f"{path}/documents")
    return Index(spark.read.parquet(f"{path}/tokens"), spark.read.parquet(f"{path}/postings"), _prefix_table(spark, path), documents, longest, tries)


# --- interchange: one JSON object with documents, token types, references and three tries -----------------------------------------


class Node:
    """A trie's node; a grafted edge leads to a node whose parent is another."""

    __slots__ = ("children", "parent", "tokens")

    def __init__(self, parent: Node | None = None):
        self.parent, self.children, self.tokens = parent, {}, []

    def walk(self, text: str) -> Node | None:
        at: Node | None = self
        for ch in text:
            at = at.children.get(ch) if at else None
        return at

    def all(self) -> list[Node]:
        """Every node that can be reached, children before parents."""
        out, seen, todo = [], {id(self)}, [(self, iter(list(self.children.values())))]
        while todo:
            node, rest = todo[-1]
            child = next(rest, None)
            if child is None:
                out.append(node)
                todo.pop()
            elif id(child) not in seen:
                seen.add(id(child))
                todo.append((child, iter(list(child.children.values()))))
        return out


def trie(tokens: list[tuple[int, str]]) -> Node:
    root = Node()
    for token, text in tokens:
        at = root
        for ch in text:
            if ch == "\0":
                raise ValueError("U+0000 can't be stored")
            if ch not in at.children:
                at.children[ch] = Node(at)
            at = at.children[ch]
        at.tokens.append(token)
    return root


def graft(root: Node, rules: list[tuple[str, str]]) -> Node:
    """Wherever a rule's right side leads on from a node, its left side leads there too; until nothing is to add."""
    for a, b in rules:
        if len(b) > len(a):
            raise ValueError(f"{a!r} to {b!r} lengthens")
    changed = True
    while changed:
        changed = False
        for node in root.all():
            for a, b in rules:
                target = node.walk(b)
                if target is None:
                    continue
                at = node
                for ch in a[:-1]:
                    if ch not in at.children:
                        at.children[ch] = Node(at)
                        changed = True
                    at = at.children[ch]
                have = at.children.get(a[-1])
                if have is None:
                    at.children[a[-1]] = target
                    changed = True
                elif have is not target:
                    raise ValueError(f"the path {a!r} leads elsewhere")
    return root


def serialize_trie(root: Node | list[tuple[int, str]]) -> list[int]:
    """For each node its parent (0 for the root), then child code points and child ids in turn as two lists, then -(token + 1) for each token that ends
    there, or 0 for none. Nodes count from 1 in the order in which they are met, depth first."""
    root = trie(root) if isinstance(root, list) else root
    number: dict[int, int] = {}
    order: list[Node] = []

    def of(node: Node) -> int:
        if id(node) not in number:
            number[id(node)] = len(order) + 1
            order.append(node)
        return number[id(node)]

    of(root)
    done, todo = {id(root)}, [(root, iter(root.children.values()))]
    while todo:
        node, rest = todo[-1]
        child = next(rest, None)
        if child is not None:
            of(child)
            if id(child) not in done:
                done.add(id(child))
                todo.append((child, iter(child.children.values())))
            continue
        if node.parent is not None:
            of(node.parent)
        todo.pop()
    out: list[int] = []
    for node in order:
        out += [of(node.parent) if node.parent is not None else 0, *map(ord, node.children), *(of(c) for c in node.children.values())]
        out += [-(t + 1) for t in node.tokens] or [0]
    return out


def read_trie(data: list[int]) -> Node:
    """The root. A node's record ends at the first value that isn't positive, and its negative followers."""
    nodes: list[Node] = []
    links: list[tuple[int, list[int], list[int]]] = []
    at = 0
    while at < len(data):
        up, at = data[at], at + 1
        own = []
        while at < len(data) and data[at] > 0:
            own.append(data[at])
            at += 1
        node = Node()
        if at < len(data) and data[at] == 0:
            at += 1
        else:
            while at < len(data) and data[at] < 0:
                node.tokens.append(-data[at] - 1)
                at += 1
        nodes.append(node)
        links.append((up, own[: len(own) // 2], own[len(own) // 2 :]))
    for node, (up, points, ids) in zip(nodes, links):
        node.parent = nodes[up - 1] if up else None
        node.children = {chr(p): nodes[i - 1] for p, i in zip(points, ids)}
    return nodes[0] if nodes else Node()


def deserialize_trie(data: list[int]) -> dict[int, str]:
    """Token texts by id, along the edges that lead from parent to child; grafted ones are other ways to a node."""
    out, todo = {}, [(read_trie(data), "")]
    while todo:
        node, text = todo.pop()
        out |= dict.fromkeys(node.tokens, text)
        todo += [(c, text + ch) for ch, c in node.children.items() if c.parent is node]
    return out


def accepted(root: Node, text: str, below: bool = False) -> set[int]:
    """The tokens at the end of a path, grafted or not; below: of all nodes under it too."""
    node = root.walk(text)
    if node is None:
        return set()
    return {t for n in (node.all() if below else [node]) for t in n.tokens}


def export_json(index: Index, bundle_documents: bool = True) -> str:
    """The whole index as one JSON object, for small ones, as a page or another program loads it: this gathers it on the driver. Documents are numbered by
    their place in the order of their ids."""
    docs = [(r["doc_id"], r["text"]) for r in index.documents.select("doc_id", "text").orderBy("doc_id").collect()]
    place = {d: i for i, (d, _) in enumerate(docs)}
    tokens = index.tokens.orderBy("token_id").collect()
    found: list[list[list[int]]] = [[] for _ in tokens]
    for r in index.postings.orderBy("token_id", "doc_id").collect():
        found[r["token_id"]].append([place[r["doc_id"]], *(x for o in r["offsets"] for x in (o["start"], o["end"]))])
    dakuten = [(base + mark, one) for mark, pairs in T.COMPOSED.items() for base, one in pairs.items()]
    rules = {"romaji": T.ROMAJI_RULES, "kana": dakuten, "other": []}
    tries = {name: serialize_trie(graft(trie([(r["token_id"], r["text"]) for r in tokens if r["trie"] == name]), rules[name])) for name in rules}
    out = {"documents": [t for _, t in docs]} if bundle_documents else {}
    return json.dumps(out | {"tokenTypes": [r["type"] for r in tokens], "tokenReferences": found, "tries": tries}, ensure_ascii=False)


def import_json(spark: SparkSession, text: str, documents: DataFrame | None = None, path: str | None = None) -> Index:
    """An index from ``export_json``, or from another program that writes the same fields."""
    data = json.loads(text)
    if documents is None:
        if data.get("documents") is None:
            raise ValueError("the index holds no documents; pass them to import_json()")
        documents = spark.createDataFrame(list(enumerate(data["documents"])), "doc_id long, text string")
    texts = {t: x for name in ("romaji", "kana", "other") for t, x in deserialize_trie(data["tries"][name]).items()}
    rows = [(i, kind, texts[i], len(texts[i])) for i, kind in enumerate(data["tokenTypes"])]
    tokens = spark.createDataFrame(rows, "token_id long, type int, text string, cp_len int").withColumn("trie", trie_of(F.col("type")))
    spans = [(i, r[0], [(r[k], r[k + 1]) for k in range(1, len(r), 2)]) for i, refs in enumerate(data["tokenReferences"]) for r in refs]
    found = spark.createDataFrame(spans, "token_id long, doc_id long, offsets array<struct<start:int,end:int>>")
    path = path or scratch_path(spark, "index")
    Index(tokens, found, prefixes(tokens), bundled(documents)).write(path)
    return load(spark, path)
