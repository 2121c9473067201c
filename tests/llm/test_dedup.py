import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foldstone.llm import components, line_chunks, near_dup, packing, quality, queries, secrets
from foldstone.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000)] + [(9000, 9001 + i) for i in range(50)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    want = {n: root(n) for n in parent}
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_write_few_tables(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "materialize", lambda df, name, write=components.materialize: written.append(name) or write(df, name))
    stars = [(10 * i + j, 10 * i) for i in range(40) for j in range(1, 8)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(stars, "u long, v long")).collect()}
    assert got == {10 * i + j: 10 * i for i in range(40) for j in range(8)}
    assert written == ["links", "least"]  # finished links are seen before another round is written


def test_near_duplicates_link_parts_only(spark, monkeypatch):
    linked, below = [], []
    monkeypatch.setattr(near_dup, "forest_roots", lambda links: components.forest_roots(below.append(links.collect()) or links))
    monkeypatch.setattr(near_dup, "connected_components", lambda links: connected_components(linked.append(links.collect()) or links))
    rows = edited_group(140, 1) + [(i, " ".join(f"w{j}" for j in range(10 * i, 10 * i + 100))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs).collect()}
    assert got == brute_components(rows)
    # each class's link to its pivot is settled before: what is left links roots
    assert len(linked) == len(below) == 1 and below[0] and linked[0]
    assert not {r["u"] for r in below[0]} & {x for r in linked[0] for x in (r["u"], r["v"])}


def test_forest_roots(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "materialize", lambda df, name, write=components.materialize: written.append(name) or write(df, name))
    links = [(i + 1, i) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 50)] + [(2001, 2000), (2003, 2001), (2002, 2000)]
    got = {r["node"]: r["label"] for r in components.forest_roots(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {u: 0 if u <= 200 else u // 1000 * 1000 for u, _ in links}
    assert len(written) <= 10
    assert components.forest_roots(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 3 line dedup


def own_chunks(lines):
    """The chunks of a text by the rule's own words: a hash of the last two lines' hashes ends a chunk, as do a line of 50
    words, the line before one, and 64 lines."""
    import xxhash

    base, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    out, chunk = [], []
    for i, line in enumerate(lines):
        chunk.append(i)
        rolled = xxhash.xxh64_intdigest(line) + (base * xxhash.xxh64_intdigest(lines[i - 1]) if i else 0) & mask
        long = [len(x.split()) >= 50 for x in lines[i : i + 2]]
        if ((rolled ^ rolled >> 29) * base >> 40 & mask) % 3 == 0 or any(long) or len(chunk) == 64 or i + 1 == len(lines):
            out.append((chunk[0], i + 1))
            chunk = []
    return out


def own_windows(lines):
    """All shortest runs of lines that reach 50 words from a line that has words on, or back from it."""
    n, out = len(lines), set()
    words = lambda a, b: len(b" ".join(lines[a:b]).split())
    for i in range(n):
        if lines[i].split():
            ahead = next(((i, j) for j in range(i + 1, n + 1) if words(i, j) >= 50), None)
            back = next(((j, i + 1) for j in range(i, -1, -1) if words(j, i + 1) >= 50), None)
            out |= {x for x in (ahead, back) if x}
    return out


def brute_dedup(rows, passages=False):
    """(doc_id, text) -> text: every chunk of every document in one dictionary of bytes."""
    keyed = sorted({(r[0] is not None, r[0], _key(r[1]), r[1]) for r in rows if r[1] is not None}, key=lambda x: (x[0], x[1] or 0, x[2]))
    first, spans, out = {}, {}, {}
    for at, (_, doc, _, text) in enumerate(keyed):
        lines = text.encode().split(b"\n")
        taken = {(a, b) for a, b in own_chunks(lines) if len(b" ".join(lines[a:b]).split()) >= (50 if b - a == 1 else 10)}
        spans[at] = sorted(taken | own_windows(lines) if passages else taken)
        for a, b in spans[at]:
            first.setdefault(b"\n".join(lines[a:b]), (at, a, b))
    for at, (_, doc, _, text) in enumerate(keyed):
        lines, gone = text.encode().split(b"\n"), set()
        for a, b in spans[at]:
            where, fa, fb = first[b"\n".join(lines[a:b])]
            if where != at or a >= fb:
                gone.update(range(a, b))
        out[(doc, text)] = b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode()
    return out


def _key(text):
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).astype(np.int64)


def test_line_dedup_against_brute_force(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(documents.select(F.col("doc_id") + 1000, "text", "lang", "source", "n_chars").toDF("doc_id", "text", "lang", "source", "n_chars"))
    before = {(r["doc_id"], r["text"]) for r in docs.collect()}
    for passages in (False, True):
        want = brute_dedup(before, passages)
        got = line_chunks.remove_repeats(docs, passages=passages)
        assert got.columns == docs.columns and got.count() == docs.count()
        texts = {}
        for r in got.collect():
            texts.setdefault(r["doc_id"], set()).add(r["text"])
        for doc, text in before:
            assert (want[(doc, text)] if text is not None else None) in texts[doc]
        assert any(len(want[k]) < len(k[1]) for k in want)


def test_bytes_decide_where_hashes_meet(spark):
    rows = [(i, "\n".join(" ".join(f"l{i}w{j}n{k}" for k in range(60)) for j in range(4))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_chunks.remove_repeats(docs, bits=2).collect()}
    assert got == dict(rows)


def test_chunks_resist_shifts():
    lines = [f"line number {i * 37 % 101} of the text".encode() for i in range(120)]
    ends = lambda ls: {b"\n".join(ls[a:b]) for a, b, _ in line_chunks.chunk_ends(ls)}
    shared = ends(lines) & ends([b"a new first line", *lines])
    assert len(shared) >= len(ends(lines)) - 3
    assert [b for a, b, _ in line_chunks.chunk_ends(lines)][-1] == 120


def test_line_dedup_columns_may_have_any_name(spark):
    passage = "\n".join(" ".join(f"l{j}w{k}" for k in range(30)) for j in range(3))
    docs = spark.createDataFrame([(i, f"own {i}\n{passage}", "a", "b", "c", "d", "e") for i in range(3)], "doc_id long, text string, id string, text_key string, marks string, unlike string, places string")
    for bits in (128, 1):
        got = line_chunks.remove_repeats(docs, bits=bits, passages=True)
        rows = got.collect()
        assert got.columns == docs.columns and all(tuple(r)[2:] == ("a", "b", "c", "d", "e") for r in rows)
        assert bits < 128 or sorted(r["text"] for r in rows) == sorted([f"own 0\n{passage}", "own 1", "own 2"])


def test_line_dedup_cases(documents, empty, spark):
    rows = line_chunks.dedup_report(documents).collect()
    assert len(rows) == 8 and line_chunks.dedup_report(empty).count() == 0
    assert {r["text"] for r in rows if r["doc_id"] == 1} == {None}
    passage = " ".join(f"shared{i}" for i in range(55))
    docs = spark.createDataFrame([(i, f"own line {i}\n{passage}\nlast line {i}") for i in range(5)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_chunks.remove_repeats(docs).collect()}
    assert passage in got[0] and got[3] == "own line 3\nlast line 3"


def test_repeated_passages_go_whole(spark):
    rng = np.random.default_rng(4)
    rows, own, passages = [], {}, {}
    for group, n in enumerate((1, 2, 3, 4, 6, 8, 20) * 6):
        words, cuts = [f"p{group}w{i}" for i in range(60)], np.sort(rng.choice(np.arange(1, 60), n - 1, replace=False))
        passages[group] = [" ".join(x) for x in np.split(np.array(words), cuts)]
        for copy in range(6):
            doc = group * 10 + copy
            mine = [" ".join(f"d{doc}l{i}w{j}" for j in range(rng.integers(1, 30))) for i in range(rng.integers(2, 9))]
            at = int(rng.integers(1, len(mine)))
            own[doc] = "\n".join(mine)
            rows.append((doc, "\n".join(mine[:at] + passages[group] + mine[at:])))
    same = "\n".join(["one line of eleven words that stands there again and again"] * 40)
    docs = spark.createDataFrame(rows + [(9000, same), (9001, same)], "doc_id long, text string")
    for bits in (128, 6):
        got = {r["doc_id"]: r["text"] for r in line_chunks.remove_repeats(docs, bits=bits, passages=True).collect()}
        before = dict(rows)
        assert bits < 128 or all(got[d] == (before[d] if d % 10 == 0 else own[d]) for d in before)
        assert all(set(own[d].split("\n")) <= set(got[d].split("\n")) for d in own)
        assert all(set(passages[g]) <= set(got[g * 10].split("\n")) for g in passages)
    assert got[9000].count("one line") >= 1
    lines = {r["doc_id"]: r["n_removed"] for r in line_chunks.dedup_report(docs).collect()}
    assert all(lines[d] == (len(passages[d // 10]) if d % 10 else 0) for d in own)


def test_line_dedup_writes_two_tables(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(line_chunks, "materialize", lambda df, name, *more, write=line_chunks.materialize: written.setdefault(name, df) and write(df, name, *more))
    passage = "\n".join(" ".join(f"l{j}w{k}" for k in range(30)) for j in range(3))
    docs = spark.createDataFrame([(i, f"own {i}\n{passage}") for i in range(9)], "doc_id long, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["doc_id"]: r["text"] for r in line_chunks.remove_repeats(docs, passages=True).collect()}
        plan = written["marked"]._jdf.queryExecution().sparkPlan().toString(), written["marked"]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == {i: f"own {i}" + f"\n{passage}" * (i == 0) for i in range(9)}
    assert list(written) == ["chunks", "marked"]
    # both sides of the chunks' join are dealt for it alone, so a chunk with many places may be split
    assert "SortMergeJoin [hash" in plan[0] and "hashpartitioning(repeated" in plan[1]


def test_line_dedup_worker_holds_few_rows(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(line_chunks, "MOST_ROWS", 1000)
    texts = ["\n".join(f"d{d}l{i}" for i in range(2000)) for d in range(3)]
    part = pa.RecordBatch.from_pydict({"id": [0, 1, 2], "text_key": [7, 8, 9], "text": texts})
    schema = pa.schema([("hash", pa.binary()), ("id", pa.int64()), ("text_key", pa.int64()), ("place", pa.int32()), ("size", pa.int32())])
    got = list(line_chunks._batches(line_chunks._chunk_rows(part, 128, True), schema))
    assert len(got) > 3 and all(b.num_rows <= 1000 for b in got)
    spans = [(i, a, b - a) for i, t in enumerate(texts) for a, b in line_chunks.looked_up(t.encode().split(b"\n"), True)]
    assert [(r["id"], r["place"], r["size"]) for b in got for r in b.to_pylist()] == spans


# --- 7 near duplicates


def brute_components(rows):
    sets = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        sets[doc] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
    ids, parent = sorted(sets), {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in sets}


def edited_group(n, seed):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(int(rng.integers(0, 9))):
            words[int(rng.integers(0, 120))] = f"e{rng.integers(1_000_000)}"
        rows.append((seed * 10_000 + i, " ".join(words)))
    return rows


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    rows = edited_group(140, 1) + edited_group(30, 2) + [(5, "one two"), (6, "ONE two"), (7, "two one"), (8, ""), (9, None), (10, " \t")]
    monkeypatch.setattr(near_dup, "BLOCK_CLASSES", 20)  # many blocks
    monkeypatch.setattr(near_dup, "PAIRS_A_TASK", 7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_of_the_driver_tables(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs).collect()}
    assert got == set(con.execute(near_dup.oracle()).fetchall())


def test_pairs_just_above_the_limit_are_found(spark):
    rows, sizes = [], []
    for i in range(500):
        n = 40 + i % 160  # shingles of each of the two
        common = -(-75 * 2 * n // 175)  # the smallest number in common that links them
        words = [f"p{i}w{j}" for j in range(n + 4)]
        other = words[: common + 4] + [f"q{i}w{j}" for j in range(n - common)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        rows += [(10_000 + 2 * i, " ".join(f"x{w}" for w in words)), (10_001 + 2 * i, " ".join(f"x{w}" for w in other[:-1] + words[: 5 + (n < 60)]))]
        sizes.append(common / (2 * n - common))
    assert 0.75 <= min(sizes) and np.mean(sizes) < 0.757
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert all(got[2 * i + 1] == 2 * i for i in range(500))
    near = [r for r in rows if r[0] >= 10_000][:200]
    want = brute_components(near)
    assert all(got[d] == want[d][1] for d, _ in near)


def test_a_chain_of_near_copies_takes_work_in_proportion(spark, monkeypatch):
    dealt = []
    opened = near_dup._open_tasks
    monkeypatch.setattr(near_dup, "_open_tasks", lambda *a: dealt.append(opened(*a).count()) or opened(*a))
    for n in (300, 1500):
        docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(10 * i, 10 * i + 100))) for i in range(n)], "doc_id long, text string")
        got = [r["component_id"] for r in near_dup.near_duplicates(docs).collect()]
        assert len(got) == n and set(got) == {0}
    assert dealt[1] <= 6 * dealt[0] + 100 and dealt[1] < 40 * 1500


def test_a_task_names_few_pairs_or_many_rows():
    import pyarrow as pa

    def task(parts, blocks):
        n = len(parts)
        columns = {"band": [1] * n, "lo": [0] * n, "hi": [max(blocks)] * n, "block": blocks, "node": [100 - i for i in range(n)], "part": parts, "n": [50] * n, "sketch": [[7] * 8] * n}
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return near_dup._flagged(pa.table({k: pa.array(v, t) for (k, v), t in zip(columns.items(), kinds)})).to_pylist()

    assert [(r["node"], r["other"]) for r in task([1, 2], [0, 0])] == [(99, 100)]
    assert [(r["node"], r["other"]) for r in task([1, 1, 2], [0, 0, 1])] == [(98, 100), (98, 99)]
    assert [(r["node"], r["other"]) for r in task([1, 2, 3, 4], [0, 0, 0, 0])] == [(100, None), (99, None), (98, None), (97, None)]
    assert task([1, 1, 1], [0, 0, 0]) == []


def test_many_rows_without_id_are_told_apart_by_text(spark):
    rows = [(None, " ".join(f"t{i}w{j}" for j in range(30)) + " end" * (k % 2)) for i in range(150) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_dup.keep_one(docs).count() == 150 and near_dup.near_duplicates(docs).count() == 450
    clash = docs.withColumns({"id": F.lit("a"), "k1": F.lit("b"), "stays": F.lit("c"), "label": F.lit("d"), "h1": F.lit("e")})
    assert near_dup.keep_one(clash).columns == clash.columns and near_dup.keep_one(clash).where("id = 'a' and k1 = 'b' and stays = 'c'").count() == 150


def test_odd_sketches_tell_similarity():
    rows = [x.encode() for _, x in edited_group(60, 3)]
    keys, starts = near_dup.shingle_sets(rows)
    sketch = near_dup.signatures(keys, starts)["sketch"].view(np.uint64)
    sets = [set(keys[a:b].tolist()) for a, b in zip(starts, starts[1:])]
    for i in range(0, 60, 7):
        for j in range(60):
            alike = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            apart = int(np.bitwise_count(sketch[i] ^ sketch[j]).sum())
            flips = 1 - 2 * apart / near_dup.SKETCH_BITS
            if alike > 0.6:
                guess = 1 - np.log(flips) / (2 * near_dup.ROWS * near_dup.BANDS * np.log(1 - 2 / near_dup.SKETCH_BITS))
                assert abs(guess - alike) < 0.2 and (alike < 0.75 or apart <= near_dup.MOST_APART)


def test_near_duplicate_cases(documents, empty):
    rows = near_dup.near_duplicates(documents).collect()
    assert len(rows) == 8 and near_dup.near_duplicates(empty).count() == 0
    assert {r["component_id"] for r in rows if r["doc_id"] in (3, 5)} == {3}
    assert {r["kept"] for r in rows if r["doc_id"] in (1, 2, 3)} == {True}
    kept = near_dup.keep_one(documents)
    assert kept.columns == documents.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6]


def test_one_row_of_each_group_stays(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    rows = [(None, text("a"), 0), (1, text("a"), 1), (None, text("b"), 2), (None, text("c"), 3), (None, text("c"), 4), (None, text("c").upper(), 5)]
    rows += [(2, text("a"), 6), (2, text("d"), 7), (7, text("e"), 8), (7, text("e"), 9), (8, text("e") + " more", 10), (None, "", 11), (None, None, 12), (9, "", 13), (9, "", 14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long")
    kept = near_dup.keep_one(docs)
    got = {r["row"] for r in kept.collect()}
    assert kept.columns == docs.columns and kept.count() == 9
    assert {1, 2, 7, 11, 12, 13, 14} <= got and not got & {0, 6, 10}
    assert len(got & {3, 4, 5}) == 1 and len(got & {8, 9}) == 1


# --- pipeline and SQL


def test_pipeline_against_brute_force(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    good = quality.measure([t.encode() for _, t in rows], quality.Limits())["kept"]
    rows = [r for r, k in zip(rows, good) if k]
    texts = brute_dedup(rows, passages=True)
    rows = [(d, texts[(d, t)]) for d, t in rows if texts[(d, t)]]
    found = brute_components(rows)
    kept = {d for d, _ in rows if found[d][1] == d}
    got = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in got.collect()} == kept
    after = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, after, SF)
        assert after.columns == docs.columns
    assert after.where(F.col("text").rlike(secrets._FAST["access"])).count() == 0
    one_stage = docs
    for table in (documents, documents.where("false")):
        one_stage = table
        for name, stage in corpus_pipeline.STAGES:
            one_stage = stage(spark, one_stage, SF)
            assert one_stage.columns == table.columns or name == "packing"
        one_stage.collect()
    assert packing.Bins().tokens == 2048


def test_pipeline_tells_rows_of_one_id_or_none_apart(spark):
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("etaoinshrdlu"), int(rng.integers(2, 9)))) for _ in range(900)]
    prose = lambda: "\n".join(" ".join(rng.choice(words, 12)) for _ in range(12))
    a, b, c, d, e = (prose() for _ in range(5))
    near = e.replace(e.split()[40], "changed", 1).replace("\n", " ")  # on one line, so that chunks do not meet
    rows = [(5, a), (5, b), (None, c), (None, d), (None, a), (9, b), (None, None), (8, ""), (3, e.replace("\n", " ")), (4, near), (3, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, id string").repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "id"]
    kept = [r["text"] for r in docs.collect()]
    assert sorted(kept) in (sorted([a, b, c, d, e.replace("\n", " ")]), sorted([a, b, c, d, near]))
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.where("piece = 0").count() == 5


@pytest.mark.parametrize("name", ["op1_license_scan", "op2_secret_scan"])
def test_scans_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    text = lambda row: tuple(format(v, ".9f") if isinstance(v, float) else v for v in row)
    assert sorted(map(text, (tuple(r[c] for c in columns) for r in got.collect())), key=str) == sorted((text([r[names.index(c)] for c in columns]) for r in want.fetchall()), key=str)
