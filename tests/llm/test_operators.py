"""Every operator on one awkward table (nulls, empty and long texts, copies, clashing columns) and on an empty one, against brute force."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sonolex.llm import bmw, components, decontaminate, html, langid, minhash, packing, pfp, repair, repeats, suffixtree, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h long"
rng = random.Random(3)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(60)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


BASE, SHARED = prose(120), prose(50)
TEXTS = [None, "", "   \n\t ", "one", "One", BASE, BASE, BASE + " tail", prose(90) + " " + SHARED, SHARED + "\n" + prose(70), "x " * 300, "ab" * 400, prose(3000), prose(40) + " " + SHARED + " " + prose(20) + " " + SHARED, "é" * 150 + "ü", "it's  odd space", BASE.replace(" ", "  ")]
ROWS = [(i, t, "en", "s", 0, "clash", 1) for i, t in enumerate(TEXTS)]


def thue_morse(flip):
    """1,024 letters whose polynomial hashes modulo a power of two equal those of their complement."""
    return "".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(1024))


#: Rows that repeat an id, with one text or several, and rows without an id.
OWN = prose(100)
HARD = [(i, t) for i, t in enumerate(TEXTS)] + [(50, OWN), (50, OWN), (51, prose(80)), (51, prose(50) + " " + SHARED), (None, OWN + " end"), (None, prose(60)), (None, None), (60, thue_morse(0)), (61, thue_morse(1)), (None, "lone"), (8, BASE), (70, prose(17) + " " + thue_morse(0) + " " + BASE[:200]), (71, prose(17) + " " + thue_morse(1) + " " + BASE[:200])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in HARD], "doc_id long, text string, id int, component string, h string").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().split()


def key(row):
    return tuple((x is None, x) if not isinstance(x, bytearray) else (False, bytes(x)) for x in row)


def near(rows, shingle):
    """(set, component's members) of every row."""
    sets = []
    for _, t in rows:
        w = [x.lower() for x in words(t)]
        sets.append({tuple(w[j : j + shingle]) for j in range(max(1, len(w) - shingle + 1))} if w else set())
    comp = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((comp[a], comp[b]))
            comp = [x if v == y else v for v in comp]
    return sets, [[j for j, c in enumerate(comp) if c == own] for own in comp]


@pytest.mark.parametrize("shingle", [5, 2])
def test_minhash(hard, none, shingle):
    sets, members = near(HARD, shingle)
    want = [(i, len(s), min((HARD[j][0] for j in m if HARD[j][0] is not None), default=None)) for (i, _), s, m in zip(HARD, sets, members)]
    got = [(r["doc_id"], r["n_shingles"], r["component"]) for r in minhash.near_duplicates(hard, shingle=shingle).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    if shingle == 5:
        assert minhash.near_duplicates(none).count() == 0


def test_minhash_keeps_one_row_of_each_group(hard, none):
    sets, members = near(HARD, 5)
    want = [HARD[min(m, key=lambda j: (HARD[j][0] is None, HARD[j][0]))] if s else HARD[i] for i, (s, m) in enumerate(zip(sets, members)) if i == m[0]]
    left = minhash.without_near_duplicates(hard)
    assert left.columns == hard.columns
    got = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert len(got) == len(want) and sorted({r for r in got if r[0] is not None and r[1]}) == sorted({r for r in want if r[0] is not None and r[1]})
    assert minhash.without_near_duplicates(none).count() == 0


def test_minhash_finds_links_of_many_near_copies(spark):
    """Every link at 0.8 or more of many texts with random edits, against all pairs."""
    made = random.Random(9)
    rows = []
    for g in range(12):
        base = [made.choice(WORDS) + made.choice(WORDS) for _ in range(150)]
        for _ in range(12):
            own = list(base)
            for _ in range(made.randint(0, 7)):
                own[made.randrange(150)] = made.choice(WORDS)
            rows.append((len(rows), " ".join(own)))
    want = {(i, m[0]) for i, m in enumerate(near(rows, 5)[1])}
    got = {(r["doc_id"], r["component"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_minhash_links_of_a_block_are_a_forest():
    """All pairs of 200 alike sets link; as many rows as it takes to join them come out, whoever asks."""
    sets = [sorted({*range(100), 1000 + i}) for i in range(200)]
    for asks in (range(200), range(0, 200, 3)):
        rows = [(i, i, False, s) for i, s in enumerate(sets)] + [(i, i, True, sets[i]) for i in asks]
        table = pa.table({"id": pa.array([r[0] for r in rows], pa.int64()), "comp": pa.array([r[1] for r in rows], pa.int64()), "q": pa.array([r[2] for r in rows]), "s": pa.array([r[3] for r in rows], pa.list_(pa.int64()))})
        links = minhash._across(80)(table).to_pylist()
        assert len(links) == 199
        reach = {0}
        for _ in links:
            reach |= {x for r in links if reach & {r["u"], r["v"]} for x in (r["u"], r["v"])}
        assert reach == set(range(200))


def test_minhash_links_of_a_large_group_grow_with_its_size(spark, monkeypatch):
    """A group of several blocks whose texts meet but mostly miss their centre: the components of all pairs, from a few links a text."""
    made = random.Random(5)
    base = [made.choice(WORDS) + made.choice(WORDS) for _ in range(150)]
    rows = []
    for i in range(240):
        own = list(base)
        for _ in range(made.randint(3, 6)):
            own[made.randrange(150)] = made.choice(WORDS) + str(i)
        rows.append((i, " ".join(own)))
    want = {(i, m[0]) for i, m in enumerate(near(rows, 5)[1])}
    counts, save = {}, minhash.Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        counts[name] = out.count() if name.startswith("links") else 0
        return out

    monkeypatch.setattr(minhash, "BLOCK", 24)
    monkeypatch.setattr(minhash.Scratch, "save", counted)
    got = {(r["doc_id"], r["component"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert "links1" in counts and max(counts.values()) <= 4 * len(rows), counts


def reached(edges):
    """The smallest node that each node of the edges reaches."""
    least = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    while True:
        new = dict(least)
        for u, v in edges:
            if u in least and v in least and None not in (u, v):
                new[u] = new[v] = min(new[u], new[v])
        if new == least:
            return least
        least = new


@pytest.mark.parametrize("small, chunk", [(1 << 20, 1 << 18), (1 << 20, 3), (0, 3), (0, 1 << 18), (40, 5)])
def test_components(spark, monkeypatch, small, chunk):
    """One task, rounds, and rounds until one task can do the rest: paths, stars, rings, random edges, repeats, self-loops and nulls."""
    monkeypatch.setattr(components, "SMALL", small)
    monkeypatch.setattr(components, "CHUNK", chunk)
    made = random.Random(4)
    path = [*range(100, 130)]
    made.shuffle(path)
    edges = [*zip(path, path[1:]), *((200, 201 + i) for i in range(20)), *((260, 230 + i) for i in range(20)), (300, 301), (301, 302), (302, 300)]
    edges += [(made.randrange(-60, 0), made.randrange(-60, 0)) for _ in range(40)]
    edges += [(300, 301), (301, 300), (7, 7), (8, None), (None, 8), (None, None), (1 << 62, -(1 << 62))]
    scratch = components.Scratch(spark, "components")
    for rows in (edges, [(7, 7), (8, None)], []):
        found = components.connected_components(spark.createDataFrame(rows, "u long, v long").repartition(3), scratch).collect()
        assert len(found) == len({r["node"] for r in found}) and {r["node"]: r["component"] for r in found} == reached(rows)


def test_components_of_few_edges_take_no_rounds(spark, monkeypatch):
    """A path of 300 nodes in mixed order: one stored table, however many rounds it would take."""
    path = [*range(300)]
    random.Random(2).shuffle(path)
    names, save = [], components.Scratch.save
    monkeypatch.setattr(components.Scratch, "save", lambda self, df, name: names.append(name) or save(self, df, name))
    found = components.connected_components(spark.createDataFrame([*zip(path, path[1:])], "u long, v long"), components.Scratch(spark, "components")).collect()
    assert {(r["node"], r["component"]) for r in found} == {(i, 0) for i in range(300)}
    assert len(names) == 1, names


def covered(seqs, window):
    count = collections.Counter(tuple(s[i : i + window]) for s in seqs for i in range(len(s) - window + 1))
    out = []
    for s in seqs:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if count[tuple(s[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append(gone)
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_substring(hard, none, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    seqs = [words(t) for _, t in HARD]
    want = [(i, len(s), sum(gone), b" ".join(w for w, g in zip(s, gone) if not g).decode()) for (i, _), s, gone in zip(HARD, seqs, covered(seqs, 35))]
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in suffixtree.remove_repeated_passages(hard).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    if hot > 1:
        assert suffixtree.remove_repeated_passages(none).count() == 0


@pytest.mark.parametrize("hot", [2000, 1])
def test_bytes(hard, none, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    seqs = [(t or "").encode() for _, t in HARD]
    want = []
    for (i, _), s, gone in zip(HARD, seqs, covered(seqs, 200)):
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        want.append((i, len(s), sum(gone), spans, bytes(b for b, g in zip(s, gone) if not g)))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in pfp.remove_repeated_bytes(hard).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    if hot > 1:
        assert pfp.remove_repeated_bytes(none).count() == 0


def test_suffix_tree():
    made = random.Random(2)
    for _ in range(120):
        seqs = [[made.randint(0, made.choice([0, 1, 3])) for _ in range(made.randint(0, 60))] for _ in range(made.randint(1, 4))]
        seqs += seqs[:1] if made.random() < 0.5 else []
        flat, border = np.array([x for s in seqs for x in s], np.uint64), np.concatenate([[0], np.cumsum([len(s) for s in seqs])]).astype(np.int64)
        tree, found = suffixtree.SuffixTree(flat, border), collections.defaultdict(list)
        for k, s in enumerate(seqs):
            for i in range(len(s)):
                for d in range(1, len(s) - i + 1):
                    found[tuple(s[i : i + d])].append(int(border[k]) + i)
        deep = [0] * len(flat)
        for sub, places in found.items():
            for p in places if len(places) > 1 else ():
                deep[p] = max(deep[p], min(81, len(sub)))
        assert tree.depth().tolist() == deep
        nodes = {tuple(flat[p[0] : p[0] + d].tolist()): p.tolist() for d, p in tree.nodes(2)}
        assert all(sorted(found[sub]) == places for sub, places in nodes.items())
        for sub, places in found.items():  # each repeat goes on to the node below it
            assert len(places) < 2 or len(sub) < 2 or any(n[: len(sub)] == sub and p == sorted(places) for n, p in nodes.items())


def test_prefix_free_parse():
    made = random.Random(1)
    for _ in range(200):
        alphabet = made.choice(["ab", "abcdefgh ", "a", "abc\0"])
        base = "".join(made.choice(alphabet) for _ in range(made.randint(1, 400)))
        texts = []
        for _ in range(made.randint(1, 6)):
            t = base
            for _ in range(made.randint(0, 3)):
                i = made.randrange(len(t) + 1)
                t = t[:i] + made.choice(["x", "", alphabet]) + t[i + made.randint(0, 2) :]
            texts.append(t.encode() if made.random() < 0.7 else "".join(made.choice(alphabet) for _ in range(made.randint(0, 300))).encode())
        window = made.choice([64, 70, 100, 200])
        border, cnt = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64), np.array([max(0, len(t) - window + 1) for t in texts])
        count = collections.Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
        want = [count[t[i : i + window]] > 1 for t in texts for i in range(len(t) - window + 1)]
        assert pfp._solver(window)(np.frombuffer(b"".join(texts), np.uint8), border, cnt).tolist() == want


def encoded():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in TEXTS]


def test_tokens_equal_the_library():
    e = tokens.Encoder(tokens.default_tokenizer())
    for t, ids in zip(TEXTS, encoded()):
        assert e(t) == np.array(ids[:-1], "<u4").tobytes()


def test_token_columns_equal_the_library():
    """Texts of awkward characters, together in one column (sliced, null, empty), with and without an end id."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    parts = [" ", " ", " ", "\n", "\n ", "\t", "\r\n", "\u00a0", "\u2009", "\u2019", "\u3000", "\x1f", "\u200b", "<|endoftext|>", "<|end", "a", "Don't", "it's", "l'été", "x1y22", "word", "Word,", "(a)",
             "..", "漢字", "é", "e\u0301", "\u0130", "😀", "123", "٣", "ǅ", "word.", "'s", "\u0120"]
    made = random.Random(5)
    texts = [None, "", " ", "\n", "a"] + [(" " if i % 2 else "").join(made.choice(parts) for _ in range(made.randint(0, 12))) for i in range(3000)] + ["", None]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    e = tokens.Encoder(tokens.default_tokenizer())
    for kind in (pa.string(), pa.large_string()):
        ids, at = e.column(pa.array(["cut off", *texts], kind)[1:])
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
        ids, at = e.column(pa.array(texts, kind), 0)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [[*w, 0] for w in want]
    for some in ([], [None], ["", None]):
        assert e.column(pa.array(some, pa.string()), 7)[0].tolist() == [7] * len(some)


def test_token_memory_keeps_many_words(monkeypatch):
    """Words of a few columns are asked of the library once."""
    e, asked = tokens.Encoder(tokens.default_tokenizer()), []
    encoded_ = e.memory._encoded
    monkeypatch.setattr(e.memory, "_encoded", lambda units: asked.append(len(units)) or encoded_(units))
    columns = [pa.array([" ".join(f"w{i:x}" for i in range(low, low + 1000)) for low in range(start, start + 100_000, 1000)]) for start in range(100_000, 600_000, 100_000)]
    first = [e.column(c)[0].tolist() for c in columns]
    assert sum(asked) == 500_000
    asked.clear()
    assert [e.column(c)[0].tolist() for c in columns] == first and sum(asked) == 0


@pytest.mark.parametrize("sent", [0, 500_000])
def test_token_files(spark, docs, none, tmp_path, monkeypatch, sent):
    path = f"file://{tmp_path}/ids"
    repair.write_ids(docs, path, shard=500)
    monkeypatch.setattr(repair, "MOST_SENT", sent)
    got = {r["doc_id"]: r for r in repair.read_ids(spark, path).collect()}
    at = 0
    for i, ids in enumerate(encoded()):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    repair.write_ids(none, path)
    assert repair.read_ids(spark, path).count() == 0


def test_repair_random_access():
    docs_ = [np.array([rng.randint(0, 3) for _ in range(n)], np.uint32) for n in (0, 1, 500, 0, 900, 2)]
    borders = np.concatenate([[0], np.cumsum([len(d) for d in docs_])])
    shard = repair.Shard(repair.pack_shard(np.arange(6), np.concatenate(docs_), borders))
    assert len(shard.rules) and len(shard.symbols) < borders[-1]
    for i, d in enumerate(docs_):
        assert shard.document(i).tolist() == d.tolist()
        assert shard.document(i, 3, 40).tolist() == d[3:40].tolist()
    assert shard.all()[0].tolist() == np.concatenate(docs_).tolist()


@pytest.mark.parametrize("slots", [2, 1 << 18])
def test_repair_goes_on_until_no_pair_is_frequent(slots, monkeypatch):
    """Against a count of all pairs; also where pairs share a slot of the table."""
    monkeypatch.setattr(repair, "SLOTS", slots)
    made = random.Random(3)
    for _ in range(60):
        docs_ = [[made.randint(0, made.choice([0, 1, 3, 9])) for _ in range(made.choice([0, 1, 2, 50, 300]))] for _ in range(made.randint(1, 6))]
        ids, borders = np.array([x for d in docs_ for x in d], np.uint32), np.concatenate([[0], np.cumsum([len(d) for d in docs_])]).astype(np.int64)
        least = made.choice([2, 3, 8])
        seq, edge, rules, sizes, first = repair.compress(ids, borders, least)
        assert [repair.expand(seq[a:b], rules, sizes, first).tolist() for a, b in zip(edge, edge[1:])] == docs_ and edge[-1] == len(seq)
        counts = collections.Counter()
        for a, b in zip(edge, edge[1:]):
            before, odd = None, False
            for p in itertools.pairwise(seq[a:b].tolist()):
                odd = p == before and not odd  # of aaa, one
                before = p
                counts[p] += not odd
        assert max(counts.values(), default=0) < least
    ids = np.array([made.choice([1, 2, 2, 3, 5, 8, 13]) for _ in range(4000)], np.uint32)
    seq, _, rules, sizes, first = repair.compress(ids, np.array([0, 4000]), 16, 1)
    pairs = collections.Counter(itertools.pairwise(ids.tolist()))
    pairs[2, 2] = sum(len(list(g)) // 2 for x, g in itertools.groupby(ids.tolist()) if x == 2)
    best = max(pairs, key=lambda p: pairs[p])
    at = [tuple(r) for r in rules.tolist()].index(best)  # the most frequent pair is replaced wherever it stands
    assert (seq == first + at).sum() == pairs[best]
    long = np.tile(seq, 60)  # enough symbols for the table
    assert repair.expand(long, rules, sizes, first).tolist() == np.tile(ids, 60).tolist()


def test_repair_sorts_pairs_with_their_places(monkeypatch):
    """Pairs that fit 64 bits with their places aren't looked up; wide ones are, with the same grammar."""
    made, high = random.Random(8), 1 << 31
    shards = []
    for _ in range(30):
        docs_ = [[made.randint(0, made.choice([0, 1, 3, 9])) for _ in range(made.choice([0, 1, 2, 50, 300]))] for _ in range(made.randint(0, 6))]
        shards.append((np.array([x for d in docs_ for x in d], np.uint32), np.concatenate([[0], np.cumsum([len(d) for d in docs_])]).astype(np.int64)))
    wide = [repair.compress(ids + np.uint32(high), borders, 3) for ids, borders in shards]
    monkeypatch.setattr(repair, "_places_in", None)
    for (ids, borders), (seq, edge, rules, sizes, first) in zip(shards, wide):
        got = repair.compress(ids, borders, 3)
        assert (got[0] + np.uint32(high)).tolist() == seq.tolist() and got[1].tolist() == edge.tolist()
        assert (got[2] + np.uint32(high)).tolist() == rules.tolist() and got[3].tolist() == sizes.tolist()


def test_packing(docs, none):
    ids, rows = encoded(), packing.pack_documents(docs).collect()
    bins = collections.defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        assert sum(n for _, n in held) <= 2048
        assert [a for a, _ in sorted(held)] == [0, *itertools.accumulate(n for _, n in sorted(held))][:-1]
    assert sum(r["length"] for r in rows) == sum(map(len, ids))
    assert packing.pack_documents(none).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    sizes = [r.choice([1, 2, 3, 7, 20, 33, 50, 64, r.randint(1, 64)]) for _ in range(400)]
    rest, bins = [], 0
    for n in sorted(sizes, reverse=True):
        fit = [x for x in rest if x >= n]
        if fit:
            rest.remove(min(fit))
            rest.append(min(fit) - n)
        else:
            bins += 1
            rest.append(64 - n)
    used = collections.defaultdict(int)
    for n, a, b, first, each, _ in packing.plan(dict(collections.Counter(sizes)), 64):
        for k in range(b - a):
            used[first + k // each] += n
    assert len(used) == bins and max(used.values()) <= 64 and sum(used.values()) == sum(sizes)


def test_bm25(spark, docs, none, tmp_path):
    index = bmw.build_index(docs, f"file://{tmp_path}/index", shard_terms=400)
    asked = spark.createDataFrame([(1, SHARED[:80]), (2, ""), (3, "nothing-of_zz"), (4, "one " + WORDS[0]), (5, None)], "query_id long, text string")
    found = {i: bmw.terms(t) for i, t in enumerate(TEXTS)}
    mean, n = sum(map(len, found.values())) / len(found), len(found)
    want = []
    for q, text in [(1, SHARED[:80]), (4, "one " + WORDS[0])]:
        scored = []
        for i, ts in found.items():
            s = 0.0
            for t in set(bmw.terms(text)) & set(ts):
                df, tf = sum(t in x for x in found.values()), ts.count(t)
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / mean))
            if s:
                scored.append((-round(s, 6), i))
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scored)[:4])]
    got = sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in bmw.search(index, asked, 4).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want))
    assert bmw.search(bmw.build_index(none, f"file://{tmp_path}/none"), asked, 4).count() == 0


def ranked(texts, query, k):
    """Brute force over (id, text) rows."""
    found = [bmw.terms(t) for _, t in texts]
    mean, n = sum(map(len, found)) / len(found), len(found)
    df = collections.Counter(t for ts in found for t in set(ts))
    own = set(bmw.terms(query))
    part = lambda t, ts: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * ts.count(t) * 2.2 / (ts.count(t) + 1.2 * (0.25 + 0.75 * len(ts) / mean))
    scored = [(-round(sum(part(t, ts) for t in own & set(ts)), 6), -1 if i is None else i, i) for (i, _), ts in zip(texts, found) if own & set(ts)]
    return [(i, -s) for s, _, i in sorted(scored)[:k]]


@pytest.mark.parametrize("block", [8192, 7])
def test_bm25_of_long_queries_and_awkward_rows(spark, tmp_path, block):
    """Long and short queries, repeated and null ids on both sides, clashing names; few shards and many blocks."""
    made = random.Random(4)
    vocabulary = [a + b + c for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = [(i, " ".join(made.choices(vocabulary, weights, k=made.randint(1, 120)))) for i in range(260)]
    rows += [(5, rows[7][1]), (5, rows[7][1]), (None, rows[9][1]), (None, rows[9][1] + " extra"), (300, None), (301, ""), (302, rows[11][1] + " tail")]
    docs_ = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, score int, term string").repartition(2)
    index = bmw.build_index(docs_, f"file://{tmp_path}/index", shard_terms=3000)
    asked = [*rows[:40], (3, rows[3][1]), (None, rows[50][1]), (900, "ban"), (901, None), *rows[-7:]]
    got = bmw.search(index, spark.createDataFrame([(*a, 1) for a in asked], "query_id long, text string, rank int"), 6, block=block).collect()
    want = collections.Counter((q, n + 1, i) for q, t in asked for n, (i, _) in enumerate(ranked(rows, t, 6)))
    assert collections.Counter((r["query_id"], r["rank"], r["doc_id"]) for r in got) == want
    scores = collections.defaultdict(list)
    for q, t in asked:
        for n, (_, s) in enumerate(ranked(rows, t, 6)):
            scores[q, n + 1].append(s)
    assert all(min(abs(r["score"] - s) for s in scores[r["query_id"], r["rank"]]) < 2e-6 for r in got)


def test_bm25_skips_documents_that_cannot_be_found():
    """Block-max WAND scores fewer documents than hold a term, and finds the same; so does the search of many queries."""
    made = random.Random(8)
    held, sizes = [], []
    for i in range(3000):
        own = [1] * (1 + 30 * (i % 97 == 0)) + [2] * (i % 3 == 0) + [3 + made.randint(0, 50)] * 2 + [100] * made.randint(0, 40)
        held.append(np.array(own, np.uint64))
        sizes.append(len(own))
    shard = bmw.Shard.build(np.arange(3000), np.array(sizes), np.concatenate(held), np.repeat(np.arange(3000), sizes))
    shard = bmw.Shard.unpack(shard.pack())
    idf, mean = {1: 0.4, 2: 1.1, 3: 4.0}, sum(sizes) / 3000
    norm = lambda n: 1.2 * (0.25 + 0.75 * n / mean)
    every = sorted((-round(sum(w * (own == t).sum() * 2.2 / ((own == t).sum() + norm(n)) for t, w in idf.items() if (own == t).any()), 6), i) for i, (own, n) in enumerate(zip(held, sizes)))
    seen = []
    got = sorted((-s, i) for s, i in bmw.search_shard(shard, [1, 2, 3], idf, mean, 10, seen=seen))
    assert got == every[:10] and len(seen) < 1500
    best = bmw.Best(1, 10)
    bmw.search_many(shard, bmw.Asked(np.array([0, 3]), np.array([1, 2, 3], np.uint64), np.array([1, 2, 3], np.uint64), np.array([0.4, 1.1, 4.0]), mean), np.array([0]), best)
    assert [(-s, i) for s, i in zip(best.score.tolist(), best.id.tolist())] == every[:10]
    # documents of two languages: those of the other are never opened
    held = [np.array([1000 * (i % 2) + made.randint(1, 40) for _ in range(60)], np.uint64) for i in range(3000)]
    shard = bmw.Shard.build(np.arange(3000), np.full(3000, 60), np.concatenate(held), np.repeat(np.arange(3000), 60))
    asks = np.arange(1, 41, dtype=np.uint64)
    best = bmw.Best(1, 10)
    opened = bmw.search_many(shard, bmw.Asked(np.array([0, 40]), asks, asks, np.full(40, 2.0), 60.0), np.array([0]), best)
    assert opened <= 3000 // bmw.BLOCK // 2 + 8 and len(best.id) == 10 and not any(best.id % 2)


def test_bm25_holds_one_shard_at_a_time(spark, tmp_path):
    """Each shard of a task is a row group of its own, in narrow integers, and has a bounded number of documents, however short."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(100))) for i in range(400)] + [(1000 + i, "") for i in range(bmw.DOCS + 50)]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    index = bmw.build_index(docs_, f"file://{tmp_path}/index", shard_terms=8000)
    sizes = [r["n_docs"] for r in index.collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= bmw.DOCS and len(sizes) == 7
    groups = [pq.ParquetFile(f).metadata.row_group(g).num_rows for f in (tmp_path / "index").glob("*.parquet") for g in range(pq.ParquetFile(f).num_row_groups)]
    assert groups == [1] * len(sizes)
    for n, kind in ((200, "u1"), (3000, "u2"), (70000, "u4")):
        own = bmw.Shard.build(np.arange(n) * 10**12, np.ones(n, int), np.arange(n, dtype=np.uint64) % 7 + (1 << 60), np.arange(n))
        back = bmw.Shard.unpack(own.pack())
        assert all((getattr(back, f) == getattr(own, f)).all() for f, _ in bmw.Shard.FIELDS) and back.docs.dtype == kind


def test_bm25_takes_fewer_long_queries_at_once(monkeypatch):
    """Runs of queries end at a number of terms too; every query is in one run."""
    monkeypatch.setattr(bmw, "TERMS_AT_ONCE", 100)
    size = np.array([30] * 10 + [500, 1, 1, 99] + [0] * 300)
    asked = bmw.Asked(np.concatenate([[0], np.cumsum(size)]), np.zeros(size.sum(), np.uint64), np.zeros(1, np.uint64), np.ones(1), 1.0)
    runs = list(bmw._groups(asked, np.arange(len(size))))
    assert np.concatenate(runs).tolist() == list(range(len(size)))
    assert all(len(r) <= bmw.AT_ONCE and (len(r) == 1 or size[r].sum() <= 100) for r in runs) and len(runs) < 12


def test_bm25_asks_with_documents(spark, tmp_path):
    texts = {i: prose(3 if i % 3 == 0 else 90) for i in range(90)} | {40: None, 61: BASE, 80: BASE, 83: BASE}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "one"), (20, "two")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {i: bmw.terms(t) for i, t in texts.items()}
    mean, n = sum(map(len, found.values())) / len(found), len(found)
    df = collections.Counter(t for ts in found.values() for t in set(ts))
    want = {}
    for q in (0, 20, 60, 80):
        part = lambda t, ts: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * ts.count(t) * 2.2 / (ts.count(t) + 1.2 * (0.25 + 0.75 * len(ts) / mean))
        scored = [(-round(sum(part(t, ts) for t in set(found[q]) & set(ts)), 6), i) for i, ts in found.items() if set(found[q]) & set(ts)]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(sorted(scored)[:10])}
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in bmw.op5_bmw(spark, str(tmp_path)).collect()}
    assert {len(set(found[q])) > bmw.LONG for q in (0, 20, 60, 80)} == {True, False}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_language(spark, none):
    rows = [(i, x, y) for i, (x, y) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("12 34", "de"), ("the dog", None), ("und der", None)])]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs_, langid.train(docs_)).collect()}
    assert [got[i][0] for i in range(6)] == ["en", "de", "und", "und", "en", "de"]
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r["lang_pred"] for r in langid.predict(docs_, langid.train(none)).collect()} == {"und"}


def test_toxicity_and_counterfactuals(spark, none):
    bad = ["awful women", "awful men", "awful women here", "awful immigrants", "awful stuff", "awful muslims"] * 8
    good = ["nice day", "women at work", "nice men", "the garden", "a nice walk", "christians and jews"] * 8
    rows = [(i, t, int(i < len(bad))) for i, t in enumerate(bad + good)] + [(900, None, 0), (901, "", 0), (902, "nice " * 30_000 + "end", 0)]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs_, docs_)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs_, model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows)
    loose = toxicity.train(docs_, docs_, penalty=0.0)

    def gap(m):
        """The largest change of a neutral sentence's score under a swap of its group."""
        worst = 0.0
        for line in toxicity.LINES[:7]:
            value = [sum(m[0].get(f, 0) for f in toxicity.features({w, "at", "work"})) for w in line]
            worst = max(worst, max(value) - min(value))
        return worst

    assert gap(loose) > 0.3 and gap(model) < gap(loose) / 3
    assert toxicity.score(none, model).count() == 0
    assert {round(r["score"], 3) for r in toxicity.score(docs_, toxicity.train(none, docs_)).collect()} == {0.333}
    odd = spark.createDataFrame([(1, "awful stuff", "x", 1.0)] * 2 + [(None, "nice day", "y", 2.0), (None, None, None, None)], "doc_id long, text string, id string, score double")
    assert sorted(round(r["score"]) for r in toxicity.score(odd, model).collect()) == [0, 0, 1, 1]
    left = toxicity.without_toxic(odd, model)
    assert left.columns == odd.columns and sorted(str(r["text"]) for r in left.collect()) == ["None", "nice day"]


def test_toxicity_swaps_one_sentence_at_a_time():
    found = toxicity.swaps("Women sang. Then women and muslims left.\nThe end.")
    names = {f: w for line in toxicity.LINES for w in line for f in toxicity._features(w)}
    said = {(frozenset(names[f] for f in plus), frozenset(names[f] for f in minus)) for plus, minus in found}
    # women stay, as the other sentence names them; so a swap of the second sentence alone never takes the word away
    assert all("women" not in minus for _, minus in said)
    assert any("muslims" in minus for _, minus in said) and any("men" in plus and not minus for plus, minus in said)
    assert toxicity.swaps(None) == [] == toxicity.swaps("nobody here")


def test_toxicity_tells_held_out_rows(spark):
    """On the given tables: of held-out labelled rows most toxic ones are found, and clean ones are left alone."""
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in toxicity.op8_toxicity(spark, sf).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in truth if got[i]["held_out"] and truth[i] is not None]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert sum(got[i]["predicted"] for i in held if truth[i]) >= 0.6 * sum(truth[i] for i in held)
    assert sum(got[i]["predicted"] for i in held if not truth[i]) <= 0.05 * len(held)


def test_language_of_awkward_rows(spark, monkeypatch):
    """Repeated rows, long texts, clashing names, more languages than a task holds."""
    monkeypatch.setattr(langid, "HELD", 1)
    rows = [(1, "the cat and the dog " * 20_000, "en", "x", 1.0)] * 2 + [(None, "der hund und die katze", "de", None, None), (3, "le chat et le chien", "fr", "y", 2.0)]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, lang string, bucket string, score double")
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(docs_, langid.train(docs_)).collect()]
    assert sorted(got, key=str) == [(1, "en"), (1, "en"), (3, "fr"), (None, "de")]


def test_language_of_held_out_rows(spark):
    """On the given tables, learned from the other rows."""
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = langid.op6_langid(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows) and len(rows) == len(truth)
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held) > 100


def test_decontamination(spark, docs, none):
    item = "If Anna buys 12 apples for 3 euros each and then Anna sells 5 of them in town how many apples are left"
    items = spark.createDataFrame([(1, item), (2, "short one here"), (3, None), (4, "")], "item_id long, text string")
    other = item.replace("Anna", "Maria").replace("12", "40").replace("3 euros", "9 dollars")
    mixed = item.replace("Anna", "Maria", 1).replace("then Anna", "then Paul")
    rows = [(1, "Intro. " + item + " more text"), (2, prose(30) + ". " + other + " " + prose(9)), (3, mixed), (4, "a short one here too"), (5, None), (6, ""), (7, "If Anna buys 12 pears")]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (1000, 0):
        got = {(r["doc_id"], r["item_id"]): r["literal"] for r in decontaminate.contaminated(docs_, items, broadcast=limit).collect()}
        assert got == {(1, 1): True, (2, 1): False, (4, 2): True}
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(docs_, items.where("false")).count() == 0


@pytest.mark.parametrize("n", [8, 9, 10, 11, 12, 14, 16, 17, 22, 39])
def test_decontamination_stands_edits(spark, n):
    w = [a + b for a in "bcdfghjklm" for b in ("ab", "eb", "ib", "ob")][:n]
    lead = "zz yy xx ww. "
    rows = [(100 + i, w[:i] + ["qq"] + w[i + 1 :]) for i in range(n)] + [(200 + i, w[:i] + ["qq"] + w[i:]) for i in range(1, n)] + [(300 + i, w[:i] + w[i + 1 :]) for i in range(n)]
    if n == 39:
        rows += [(1, [x if i not in (9, 19, 29) else "qq" for i, x in enumerate(w)]), (2, w[8:30]), (3, w[19:] + ["pp"] * 60 + w[:12])]
    rows += [(4, [w[i % n] if i % 3 else "qq" for i in range(2 * n)])]
    docs_ = spark.createDataFrame([(i, lead + " ".join(x) + " uu tt") for i, x in rows], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(docs_, items).collect()} == {i for i, _ in rows} - {4}


def test_decontamination_follows_fillers_of_other_length(spark):
    item = "in the evening Anna counts 12 red apples on the table and later Anna gives 5 of them to her old friend from school"
    rows = [(1, item.replace("Anna", "Anna Maria")), (2, item.replace("Anna", "Maria", 1).replace("later Anna", "later Paul")), (3, item.replace("12", "30"))]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r["literal"] for r in decontaminate.contaminated(docs_, items).collect()}
    assert set(got) == {1, 3} and not got[3]


def test_html(spark):
    page = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- x --><div class="ad">Buy now.</div><article><h1>Title &amp; more</h1><p>First   line<br>goes <b>on</b>.<p>Second &eacute;.</p></article><footer>&copy; me</footer>'
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<!-- never closed"), (5, "u", "<script>x")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = "Title & more First line goes on. Second é."
    assert got[1] == (want, len(want)) and all(got[i] == ("", 0) for i in (2, 3, 4, 5))


SENTENCE = "One sentence of about a hundred and forty characters that goes on for a while, so that any reader would take it for the prose of an article."
PAGES = [  # (body, article), framed by a menu and a footer
    (f"<article><p>{SENTENCE}</p></article>", SENTENCE),
    (f"<main><p>{SENTENCE}</p></main>", SENTENCE),
    ("<article><div>text</div></article>", "text"),
    ('<article><h1>Title</h1><p>Body.</p><ul><li><a href="x">Source one</a></li><li><a href="y">Source two</a></li></ul></article>', "Title Body. Source one Source two"),
    (f"<article><h1>Steps</h1><ol><li>{SENTENCE}</li></ol></article>", f"Steps {SENTENCE}"),
    (f"<p>{SENTENCE}</p><p>Second paragraph of the text.</p>", f"{SENTENCE} Second paragraph of the text."),
    (f"<article><h1>A</h1><svg/><p>{SENTENCE}</p></article>", f"A {SENTENCE}"),
    ("<article><h1>A</h1><p>x <math><mi>y</mi></math> z <object>o</object></p><button>Like</article>", "A x y z o"),
    (f'<div class="content"><h2>Head</h2><p>{SENTENCE}</p><div class="share"><a>Tweet</a></div></div><div id="comments"><h3>Comments</h3><div class="comment"><p>Nice post, thanks a lot for this!</p></div></div>', f"Head {SENTENCE}"),
    (f"<article><header><h1>Title</h1></header><p>{SENTENCE}</p><aside>Related: <a>x</a></aside><footer><a>Tag</a></footer></article>", f"Title {SENTENCE}"),
    (f'<main><article><h1>T</h1><p>{SENTENCE}</p><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table></article></main><div class="cookie-notice">We use cookies. <button>OK</button></div>', f"T {SENTENCE} A B 1 2"),
    (f'<article><h1>T</h1><p>{SENTENCE}</p></article><form action="/s"><label>Search</label><input><p>Find anything on this site quickly.</p></form><section class="comments"><ol><li>First! great read, I liked it.</li></ol></section>', f"T {SENTENCE}"),
    ("<article></article>", ""),
]


@pytest.mark.parametrize("body,want", PAGES)
def test_html_keeps_the_article_alone(body, want):
    frame = '<!DOCTYPE html><html><head><title>T</title></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav>{}<footer>&copy; 2020 Example Inc. <a href="/t">Terms</a></footer></body></html>'
    assert html.main_text(frame.format(body), html.default_model()) == want


def test_html_without_a_frame():
    model = html.default_model()
    assert html.main_text("Just plain text without a tag.", model) == "Just plain text without a tag."
    assert html.main_text("<body><p>Only one.</p></body>", model) == "Only one."
    assert html.main_text(f"<article><p>{SENTENCE}</p></article>", model) == SENTENCE


def test_html_finds_every_article_of_the_tables_pages():
    """The given pages mark their article; a plain cut of it is the brute-force version."""
    import html as entities
    import re

    import duckdb

    pages = duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()
    for (page,) in pages:
        article = re.search("<article>(.*?)</article>", page, re.S)[1].replace("<b>", "").replace("<br>", " ")
        blocks = [" ".join(entities.unescape(x).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert html.main_text(page, html.default_model()) == " ".join(x for x in blocks if x)


def test_html_precision_and_recall_on_pages_it_was_not_fitted_on():
    weight, edge = html.default_model()
    right = found = there = 0
    for nodes in html.labelled_pages(150, seed=77):
        belief, _ = html.sum_product(nodes, [sum(weight.get(f, 0.0) for f in fs) for fs in html.features(nodes)], edge)
        for n, b in zip(nodes, belief):
            right += n.own * (b >= 0 and n.y == 1)
            found += n.own * (b >= 0)
            there += n.own * (n.y == 1)
    assert right / found > 0.97 and right / there > 0.97


def test_html_tables(spark):
    kinds = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", "<p>a b</p>", "x", 1)] * 2 + [(None, None, "<p>c</p>", None, None), (2, "v", "<div>" * 5000 + "</ul>" * 5000, "x", 1)]
    got = sorted(tuple(r) for r in html.extract(spark.createDataFrame(rows, kinds), keep=("page_id",)).fillna(-1).collect())
    assert got == [(-1, "c", 1), (1, "a b", 3), (1, "a b", 3), (2, "", 0)]
    assert html.extract(spark.createDataFrame([], kinds)).count() == 0


def test_sum_product_is_exact():
    r = random.Random(1)
    for _ in range(20):
        nodes = [html.Node("html", -1)] + [html.Node(r.choice(["p", "div", "li", "h1", "nav"]), r.randrange(i)) for i in range(1, 7)]
        unary = [r.uniform(-2, 2) for _ in nodes]
        edge = {k: [r.uniform(-1, 1) for _ in range(4)] for k in html.KINDS}
        total, one = 0.0, [0.0] * 7
        for y in itertools.product((0, 1), repeat=7):
            e = sum(u * v for u, v in zip(unary, y)) + sum(edge[html.kind(nodes[i].tag)][2 * y[nodes[i].parent] + y[i]] for i in range(1, 7))
            total += math.exp(e)
            for i in range(7):
                one[i] += y[i] * math.exp(e)
        belief, _ = html.sum_product(nodes, unary, edge)
        assert all(abs(html._sigmoid(b) - x / total) < 1e-9 for b, x in zip(belief, one))


def test_decontamination_of_awkward_rows(spark):
    """Rows without an id or with one that repeats, very long texts, clashing names, short items, names of several words; a bitmap instead of all hashes."""
    item = "In the evening Anna counts 12 red apples on the table and later Anna gives 5 of them to her old friend from school"
    far = "word " * 40_000
    rows = [(1, item), (1, "clean text"), (None, far + item + " " + far), (2, item.replace("Anna", "Mary Jane")), (2, item.replace("Anna", "Mary Jane")), (3, "there were 7 and 9"), (4, "the answer is ((((((((((42)))))))))) today"), (5, None), (6, "")]
    docs_ = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, id int, item string")
    items = spark.createDataFrame([(1, item), (1, "42"), (None, "clean text"), (9, None), (9, "")], "item_id long, text string")
    want = collections.Counter([(1, 1, True), (None, 1, True), (2, 1, False), (2, 1, False), (4, 1, True), (1, None, True)])
    for limit in (1000, 0):
        assert collections.Counter((r["doc_id"], r["item_id"], r["literal"]) for r in decontaminate.contaminated(docs_, items, broadcast=limit).collect()) == want
    left = decontaminate.without_contaminated(docs_, items)
    assert left.columns == docs_.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 5, 6]


def test_stages_on_empty_and_repeated_rows(spark, tmp_path):
    """Every stage on no rows; of a row that is there twice, one comes out of the pipeline, whole."""
    import corpus_pipeline as P

    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    text = prose(90)
    spark.createDataFrame([(1, text, "en", "s", 9)] * 2 + [(2, prose(60), "en", "s", 9)], kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    none = spark.createDataFrame([], kinds)
    for name, stage in P.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns)
    encode = tokens.Encoder(tokens.default_tokenizer())
    got = {r["doc_id"]: r["length"] for r in P.run(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2} and got[1] == len(encode(text)) // 4 + 1


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    bad = [(100 + i, f"awful {WORDS[i]} thing", "en", "s", 9) for i in range(40)]
    rows = [r[:5] for r in ROWS if r[1] != "awful"] + bad + [(None, "no id", "en", "s", 5)]
    labels = [(100 + i, 0, 1) for i in range(40)] + [(r[0], 1, 0) for r in ROWS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"] for r in P.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert not out & {r[0] for r in bad}
    assert not out & {3, 4, 6}  # an item, its copy, a copy
    assert {0, 1, 2, 5, 8, 9, 10, 11, 12, 13, None} <= out
