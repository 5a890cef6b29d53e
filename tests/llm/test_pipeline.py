"""The pipeline's stages, each on its own input."""

import random
import re
import zlib
from collections import Counter

import pytest
import xxhash

import corpus_pipeline as pipeline
from talentloom.llm import similar
from talentloom.llm.common import stored
from talentloom.llm.mixing import mix_sources

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def _prose(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ba", "lo", "mi", "tu", "ne", "sk"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows, labels = [], []
    for i in range(300):
        text = _prose(i)
        if i % 5 == 0:
            text = text.replace(" ", " idiot zorkle ", 3)
        if i % 7 == 1:
            text += " write to p.q@mail.example now"
        rows.append((i, text, "en", f"s{i % 3}", len(text), "x"))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(1000 + i, rows[i][1], "en", "s0", rows[i][4], "x") for i in range(1, 5)]
    rows += [(2000, None, None, None, None, None), (2001, "", "en", None, 0, "x"), (None, _prose(9999), "en", "s1", 5, "x")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}", rows, dict((i, t) for i, _, t in labels)


def test_stages(spark, world):
    sf_dir, rows, toxic = world
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "pii", "mixing", "packing"]
    kept = stored(pipeline.toxicity(spark, docs, sf_dir), "t1")
    assert kept.columns == docs.columns
    left = Counter(r.doc_id for r in kept.collect())
    assert not [i for i in left if i in toxic and toxic[i] and i % 3 != 0 and left[i] > 1]
    assert sum(toxic.get(i, 0) for i in left) <= 3
    assert all(left[i] == 1 for i, t in toxic.items() if not t)
    once = stored(pipeline.near_duplicate_removal(spark, kept, sf_dir), "t2")
    ids = {r.doc_id for r in once.collect()}
    assert ids == set(left) - {1000 + i for i in range(1, 5)} - {2001}
    clean = stored(pipeline.personal_data(spark, once, sf_dir), "t3")
    texts = {r.doc_id: r for r in clean.collect()}
    assert set(texts) == ids and not any("@" in (r.text or "") for r in texts.values()) and texts[1].text.endswith("write to <email> now")
    assert all(r.n_chars == len(r.text) for r in texts.values() if r.text is not None)
    want = sum(r.taken for r in mix_sources(clean).collect())
    mixed = stored(pipeline.mixing(spark, clean, sf_dir), "t4")
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in mixed.collect()) == want
    packed = pipeline.packing(spark, mixed, sf_dir).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in mixed.collect())


def test_run(spark, world):
    out = pipeline.run(spark, world[0])
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def _near_copies_out(rows):
    """Of each group of near copies by all pairs the row with the smallest id."""
    sets = []
    for _, text, *_ in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x == sets[j] or 5 * both >= 4 * (len(x) + len(sets[j]) - both):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [r for i, r in enumerate(rows) if top(i) == i]


def test_run_against_a_brute_force_version(spark, world, tmp_path):
    """Every stage done plainly on what the one before it left; only the trained classifier is the stage's own."""
    import duckdb
    import numpy as np
    import pandas as pd
    from tokenizers import Tokenizer

    from talentloom.llm import oracle
    from talentloom.llm.queries import WORD_BPE, WORD_END
    from talentloom.llm.toxicity import THRESHOLD, train

    rows = sorted(r for r in world[1] if r[0] is not None)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{world[0]}/labels.parquet").write.parquet(f"file://{tmp_path}/labels.parquet")
    docs, labels = (spark.read.parquet(f"file://{tmp_path}/{name}.parquet") for name in ("documents", "labels"))
    toxic = {r.doc_id for r in train(docs, labels).score(docs, "text", ("doc_id",)).collect() if r.score >= THRESHOLD}
    assert len(toxic & {i for i, bad in world[2].items() if bad}) > 0.8 * sum(world[2].values())
    left = _near_copies_out([r for r in rows if r[0] not in toxic])
    left = [(i, None if t is None else re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<email>", t), s) for i, t, _, s, *_ in left]
    documents = pd.DataFrame(left, columns=["doc_id", "text", "source"])  # read by name below
    with duckdb.connect() as con:
        con.register("documents", documents)
        mix = {r[0]: (r[1], r[4]) for r in con.execute(oracle.mixing_sql()).fetchall()}
    plain, want = Tokenizer.from_file(WORD_BPE.path), Counter()
    for i, text, _ in left:
        size, taken = mix[i]
        copies = [text] * (taken // size if size else 0) + ([" ".join(text.split()[: taken % size])] if size and taken % size else [])
        for copy in copies:
            ids = plain.encode(copy, add_special_tokens=False).ids + [WORD_END]
            want.update((i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096))
    out = pipeline.run(spark, f"file://{tmp_path}").collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in bins.values():
        ends = [a + n for a, n in sorted(spots)]
        assert [a for a, _ in sorted(spots)] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_run_over_nothing_and_over_repeated_rows(spark, world, tmp_path):
    empty, twice = f"file://{tmp_path}/empty", f"file://{tmp_path}/twice"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert pipeline.run(spark, empty).count() == 0
    rows = [(7, _prose(1), "en", "a", 5, "x")] * 5 + [(8, _prose(2), "en", "a", 5, "x")] * 3 + [(None, _prose(3), "en", "b", 5, "x")] * 4 + [(None, None, None, None, None, None)] * 2
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{twice}/documents.parquet")
    spark.createDataFrame([(7, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{twice}/labels.parquet")
    once = pipeline.near_duplicate_removal(spark, spark.read.parquet(f"{twice}/documents.parquet"), twice).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:9]) for r in once) == sorted([(7, _prose(1)[:9]), (8, _prose(2)[:9]), (0, _prose(3)[:9]), (0, "")])
    packed = pipeline.run(spark, twice).collect()
    assert {r.doc_id for r in packed} <= {7, 8, None} and {7, 8} <= {r.doc_id for r in packed}


def _edited(text, places):
    tokens = text.split()
    for at in places:
        tokens[at] = f"new{at}"
    return " ".join(tokens)


def _without_copies(rows, radius=similar.RADIUS):
    """Row numbers that stay, over all pairs."""
    sets, marks = [], []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append(frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([" ".join(w)] if w else []))
        hashes = [xxhash.xxh64_intdigest(x, 42) for x in sets[-1]]
        marks.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or (marks[i] ^ marks[j]).bit_count() <= radius and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return sorted(min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)) for g in groups.values())


@pytest.mark.parametrize("radius, tile, tile_bytes", [(similar.RADIUS, 8192, 8 << 20), (64, 5, 2000)])
def test_near_duplicates_against_all_pairs(spark, radius, tile, tile_bytes):
    r = random.Random(3)
    rows = []
    for i in range(12):
        base = _prose(500 + i, 120)
        rows.append((len(rows), base))
        for _ in range(9):  # similarities on both sides of 0.8
            rows.append((len(rows), _edited(r.choice(rows)[1] if i == 0 else base, r.sample(range(120), r.randint(1, 4)))))
    rows += [(len(rows), "one two"), (len(rows) + 1, "one two"), (len(rows) + 2, ""), (len(rows) + 3, None), (None, rows[3][1]), (None, _prose(4)), (None, _prose(4))]
    data = [(i, k, t) for i, (k, t) in enumerate(rows)]
    docs = stored(spark.createDataFrame(data, "_row long, _key long, _text string"), "near")
    gone = {x._row for x in similar.first_of_each(docs, radius, tile, tile_bytes).collect()}
    assert sorted(set(range(len(rows))) - gone) == _without_copies(rows, radius)


def test_near_duplicates_where_parities_do_not_help(spark):
    """Sets so large that all their parities are mixed: the second check decides."""
    r = random.Random(8)
    base = _prose(600, 4000)
    rows = [(i, _edited(base, r.sample(range(4000), r.randint(30, 80)))) for i in range(40)]
    docs = stored(spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "_row long, _key long, _text string"), "near")
    left = _without_copies(rows)
    assert 1 < len(left) < 40
    for tile_bytes in (8 << 20, 300_000):
        gone = {x._row for x in similar.first_of_each(docs, tile_bytes=tile_bytes).collect()}
        assert sorted(set(range(40)) - gone) == left


def test_tiles_hold_all_cells_and_pairs():
    cells = [(b, p, n) for b, p, n in ((3, 30, 4), (3, 31, 5), (3, 33, 25), (3, 40, 2), (4, 20, 3), (4, 36, 1), (9, 30, 1))]
    placed, meet = similar.tiles_of(cells, 10, 5)
    where = {(b, p): range(first, first + parts) for b, p, first, parts in placed}
    assert len(where[3, 33]) == 3 and where[3, 30] == where[3, 31]
    pairs = set(meet)
    for (b, p), mine in where.items():
        for (o, q), theirs in where.items():
            for i in mine:
                for j in theirs:
                    assert (min(i, j), max(i, j)) in pairs or abs(b - o) > 1 or abs(p - q) > 5
    assert not any({i, j} & set(where[9, 30]) for i, j in pairs if i != j)


def test_near_duplicate_stage_links_at_four_fifths(spark):
    base = _prose(77, 200)
    rows = [(1, base), (2, _edited(base, [50, 120])), (3, _edited(base, [10, 60, 110, 160, 190]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _without_copies(rows) == [0, 2] and [x.doc_id for x in similar.drop_near_duplicates(docs).orderBy("doc_id").collect()] == [1, 3]
