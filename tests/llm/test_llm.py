import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import batch_linkage, markup, mixing, near_copies, neighbors, overlap_join, packing, pair_defects, pair_samples, personal_data, splitting, truncation


def sets(texts):
    out = {}
    for k, t in texts.items():
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if len(w) >= 20:
            out[k] = set(zip(w, w[1:], w[2:], strict=False))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    out = {}
    for i in range(n):
        if i % 4 and out:
            t = rng.choice(list(out.values())).split()
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(words)
        else:
            t = [rng.choice(words) for _ in range(rng.randint(15, 90))]
        out[f"k{i:03d}"] = " ".join(t)
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_copies_match_brute_force(spark):
    texts = corpus(1, 120) | {"null": None, "empty": "", "long": "x " * 50_000}
    df = spark.createDataFrame(list(texts.items()) * 2, "key string, text string")
    s = sets(texts)
    want = {(a, b) for a, b in itertools.combinations(sorted(s), 2) if jaccard(s[a], s[b]) >= 0.6}
    got = {(r.key_a, r.key_b) for r in near_copies.near_copy_pairs(df, expand=200).collect()}
    assert got == want and want
    assert near_copies.near_copy_pairs(df.limit(0)).count() == 0


def test_groups_say_the_same_as_pairs(spark):
    texts = corpus(4, 60)
    texts |= {f"c{i}": texts["k000"] for i in range(9)}
    df = spark.createDataFrame(list(texts.items()), "key string, text string")
    s = sets(texts)
    want = {(a, b) for a, b in itertools.combinations(sorted(s), 2) if jaccard(s[a], s[b]) >= 0.6}
    membership, links, degrees = near_copies.near_copy_groups(df)
    rep = {r.key: r.representative for r in membership.collect()}
    linked = {(r.key_a, r.key_b) for r in links.collect()}
    assert {(a, b) for a, b in itertools.combinations(sorted(s), 2) if rep[a] == rep[b] or tuple(sorted((rep[a], rep[b]))) in linked} == want
    assert {r.key: r.copies for r in degrees.collect()}["c0"] == sum(s[k] == s["c0"] for k in s) - 1


def test_large_classes_are_linked_to_their_representative(spark):
    text = " ".join(f"t{i}" for i in range(30))
    df = spark.createDataFrame([(f"c{i:02d}", text) for i in range(20)], "key string, text string")
    assert near_copies.near_copy_pairs(df, expand=5).count() == 19


def test_keys_with_many_rows_are_cut_into_tiles(spark, monkeypatch):
    texts = {f"k{i:02d}": " ".join(f"w{j}" for j in range(40)) + f" end{i} stop{i}" for i in range(30)}
    df = spark.createDataFrame(list(texts.items()), "key string, text string")
    monkeypatch.setattr(overlap_join, "TILE", 7)
    assert near_copies.near_copy_pairs(df).count() == 30 * 29 // 2


def test_many_ids_are_joined_instead_of_sent(spark, monkeypatch):
    monkeypatch.setattr(overlap_join, "SENT", 0)
    test_near_copies_match_brute_force(spark)


BATCH = "doc_id long, batch_no int, checksum string, source string, text string"


def one_by_one(data):
    s = sets({i: t for i, _, _, _, t in data})
    accepted, want = [], {}
    for i, b, *_ in data:
        if i in s:
            hits = [a for a in accepted if jaccard(s[a], s[i]) >= 0.7] if b else []
            if hits:
                want[i] = min(hits)
            else:
                accepted.append(i)
    return want


def test_batches_match_one_by_one_check(spark):
    texts = list(corpus(2, 100).values())
    data = [(i, i // 25, None, "s", t) for i, t in enumerate(texts)] + [(1000, 2, None, None, None), (1001, 3, None, None, "")]
    want = one_by_one(sorted(data, key=lambda r: (r[1], r[0])))
    found, index = batch_linkage.link_batches(spark.createDataFrame(data, BATCH), clusters=True)
    assert {r.doc_id_b: r.doc_id_a for r in found.collect()} == want and want
    filed = {r.doc_id: r for r in batch_linkage.best_heads(index).collect()}
    assert set(filed) == set(want) and all(r.root <= r.head for r in filed.values())
    links = {(r.doc_id, r.head) for r in index.read("links").collect()}
    up = {}
    find = lambda x: x if up.get(x, x) == x else find(up[x])
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert all(r.root == find(r.doc_id) for r in filed.values())


def test_a_batch_does_not_read_the_texts_of_earlier_ones(spark, tmp_path):
    texts = list(corpus(5, 60).values())
    data = [(i, i // 20, None, "s", t) for i, t in enumerate(texts)]
    index = batch_linkage.Index(spark, str(tmp_path / "index"))
    batch_linkage.begin(index, spark.createDataFrame([r for r in data if r[1] == 0], BATCH))
    found = {}
    for b in (1, 2):  # opened anew each time: all that is known of the batches before lies in the folder
        own = batch_linkage.Index(spark, str(tmp_path / "index"))
        found |= {r.doc_id_b: r.doc_id_a for r in batch_linkage.accept(own, spark.createDataFrame([r for r in data if r[1] == b], BATCH), b).collect()}
    assert found == one_by_one(data) and found


def test_thinned_keys_keep_what_the_batch_has(spark, monkeypatch):
    data = [(i, 0 if i < 40 else 1, None, "s", t) for i, t in enumerate(corpus(6, 60).values())]
    monkeypatch.setattr(batch_linkage, "MOST_BYTES", 1)  # no bitmap: the whole key table is joined
    assert {r.doc_id_b: r.doc_id_a for r in batch_linkage.link_batches(spark.createDataFrame(data, BATCH))[0].collect()} == one_by_one(data)


def test_learned_score_drops_no_pair(spark, monkeypatch):
    monkeypatch.setattr(batch_linkage, "agreement_weights", lambda patterns, levels: (-1000.0, [np.zeros(n) for n in levels]))
    text = " ".join(f"t{i}" for i in range(30))
    df = spark.createDataFrame([(1, 0, "x", "s", text), (2, 1, "y", "t", text + " more")], BATCH)
    assert [(r.doc_id_a, r.doc_id_b) for r in batch_linkage.link_batches(df)[0].collect()] == [(1, 2)]
    assert batch_linkage.link_batches(df.limit(0))[0].count() == 0


def test_pieces_cover_the_text(spark, tmp_path):
    rng = random.Random(3)
    text = "".join(rng.choice(["wörd ", "end. ", "line\n", "para\n\n", "x" * 40]) for _ in range(3000))
    rows = [("a", text), ("b", "x" * 5000), ("c", None), ("d", "short"), ("e", "")]
    df = spark.createDataFrame(rows, "key string, text string")
    cut = {}
    for size in (1 << 16, 3000, 1000):
        pieces = splitting.split_pieces(df, limit=500, overlap=20, size=size, halo=200).orderBy("key", "piece_no").collect()
        cut[size] = [tuple(p) for p in pieces]
        for key, t in rows[:2]:
            own = [p for p in pieces if p.key == key]
            assert own[0].start_char == 0 and own[-1].end_char == len(t)
            assert all(p.content == t[p.start_char : p.end_char] and len(p.content) <= 500 for p in own)
            assert all(n.start_char == p.end_char - 20 for p, n in itertools.pairwise(own))
    assert cut[1 << 16] == cut[3000] == cut[1000]  # where a piece ends doesn't depend on the ranges
    kinds = {r.key: r.boundary for r in splitting.boundary_kinds(df, limit=500, size=3000, halo=200).collect()}
    assert kinds["b"] == "none" and set(kinds) == {"a", "b"}
    path = tmp_path / "giant.txt"
    path.write_text(text)
    files = spark.createDataFrame([("g", str(path), path.stat().st_size)], "key string, path string, bytes long")
    spans = splitting.split_files(spark, files, 500, 20, size=2000, halo=300).orderBy("piece_no").collect()
    assert spans[0].start_char == 0 and spans[-1].end_char == len(text)
    assert all(n.start_char == p.end_char - 20 and n.end_char - n.start_char <= 500 for p, n in itertools.pairwise(spans))


def test_neighbors_recall(spark):
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((60, 64))
    x = np.repeat(centers, 20, 0) + 0.15 * rng.standard_normal((1200, 64))
    x[5] = x[6] = x[7]
    data = [(f"v{i:04d}", [float(a) for a in v]) for i, v in enumerate(x)]
    bad = [("null", None), ("short", [1.0]), ("zero", [0.0] * 64), ("v0001", data[1][1])]
    df = spark.createDataFrame(data + bad, "key string, embedding array<float>")
    got = {(r.key, r.other) for r in neighbors.nearest(df, k=10, least=0.8, cell=300).collect()}
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    sim = u @ u.T
    np.fill_diagonal(sim, -1)
    want = {(f"v{i:04d}", f"v{j:04d}") for i in range(len(u)) for j in np.argsort(-sim[i], kind="stable")[:10] if sim[i, j] >= 0.8}
    assert len(got & want) >= 0.9 * len(want)
    assert ("v0005", "v0006") in got and not any("null" in p or "zero" in p for p in got)
    assert neighbors.nearest(df.limit(0)).count() == 0


def test_every_vector_has_its_ten_nearest(spark, tmp_path):
    x = np.random.default_rng(8).standard_normal((200, 64))
    rows = [(f"v{i:03d}", [float(a) for a in v]) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "chunk_id string, embedding array<float>").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {(r.chunk_id, r.near_chunk_id) for r in neighbors.QUERIES["p3_nearest"](spark, str(tmp_path)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T
    np.fill_diagonal(sim, -2)
    want = {(f"v{i:03d}", f"v{j:03d}") for i in range(200) for j in np.argsort(-sim[i])[:10]}
    assert len(got) == 2000 and len(got & want) >= 0.9 * len(want)


def near_pairs(n, seed, away):
    """Vectors without neighbours, each followed by one at a cosine of about 1 / sqrt(1 + away^2); pairs at 0.9 or more."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n // 2, 64))
    x = np.stack([x, x + away * rng.standard_normal(x.shape)], 1).reshape(n, 64)
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    sim = u @ u.T
    np.fill_diagonal(sim, -1)
    rows = [(f"v{i:05d}", [float(a) for a in v]) for i, v in enumerate(x)]
    return rows, {(f"v{i:05d}", f"v{j:05d}") for i, j in zip(*np.nonzero(sim >= 0.9), strict=True)}


def test_vectors_travel_to_few_cells_of_many(spark, monkeypatch):
    # In 512 cells, as many as ten million vectors have, each vector used to be sent to 57 others and 6 % of the pairs were lost.
    rows, want = near_pairs(6000, 12, 0.45)
    moved, spool = [], neighbors.spool

    def counting(df, *args, **kwargs):
        out = spool(df, *args, **kwargs)
        if {"v", "cell"} <= set(out.columns):
            moved.append(out.select(F.sum(F.size("at")) if "at" in out.columns else F.count_if(F.col("cell") >= 0)).first()[0])
        return out

    monkeypatch.setattr(neighbors, "spool", counting)
    monkeypatch.setattr(neighbors, "counted", lambda df, condition=None: (out := counting(df), out.count() if condition is None else out.where(condition).count()))
    df = spark.createDataFrame(rows, "key string, embedding array<float>")
    got = {(r.key, r.other) for r in neighbors.nearest(df, cell=12).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) > 2000
    assert 6000 < sum(moved) < 25 * 6000


def test_vectors_that_trees_do_not_cover_are_sent(spark, monkeypatch):
    rows, want = near_pairs(2000, 13, 0.45)
    df = spark.createDataFrame(rows, "key string, embedding array<float>")
    monkeypatch.setattr(neighbors, "trees_for", lambda *_: (1, 0.9, 1.0))
    got = {(r.key, r.other) for r in neighbors.nearest(df, cell=60).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_all_pairs_keeps_the_best_of_many():
    x = np.random.default_rng(5).standard_normal(64) + 0.1 * np.random.default_rng(6).standard_normal((2000, 64))
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    best = neighbors.all_pairs(u, 10, 0.9)
    sim = u @ u.T
    np.fill_diagonal(sim, -1)
    assert np.allclose(best.sim, -np.sort(-sim, axis=1)[:, :10], atol=1e-6)


def test_markup_held_out():
    chain, right = markup.trained(), 0
    pages = markup.labelled_pages(120, random.Random(77))
    for text, spans, title in pages:
        items = markup.leaves(text)
        labels = chain.viterbi(markup.features(items, text, title))
        right += {markup.LABELS[y] for y in labels} - {"plain"} == {markup.LABELS[y] for y in markup.gold_labels(items, spans)} - {"plain"}
    assert right >= 0.95 * len(pages)
    text = "## Head\n\nSee **this** &amp; $x_{1}$.\n\n- one\n- two"
    found = markup.labelled(text, False, chain)
    assert {y for _, y in found} >= {"markdown", "html", "latex"}
    assert markup.clean(text, found) == "## Head\n\nSee this & $x_{1}$.\n\n- one\n- two"
    kept = lambda t: markup.clean(t, markup.labelled(t, False, chain))
    assert kept("== Part ==\n\n[[a|b]] and '''c'''.") == "# Part\n\nb and c."
    assert kept("Some **bold** words.\n\n```py\nx = 1\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |") == "Some bold words.\n\n```\nx = 1\n```\n\na | b\n\n1 | 2"
    assert markup.labelled("", False, chain) == []


def test_leaf_blocks_do_not_depend_on_length():
    kinds = lambda text: [x.kind for x in markup.leaves(text)]
    assert kinds("**word** " * 80 + "a { b").count("odd") == 1
    long = "x_1 + " * 150 + "y"
    assert "math" in kinds(f"so ${long}$ holds") and "math" in kinds(f"so \\({long}\\) holds")
    assert "display" in kinds(f"so\n$${long}$$\nholds") and "display" in kinds(f"so\n\\[{long}\\]\nholds")
    assert "display" not in kinds("costs $$ here\n\nand $$ there")


def test_pair_defects(spark):
    q = "How long does Foo keep the logs?"
    cases = [("a", q, "It keeps them for 9 days.", None, ""), ("b", q, None, None, ""), ("c", q, "TBD", None, ""), ("d", q, q.upper(), None, ""), ("e", q, "I'm sorry, but I can't help with that.", None, ""),
             ("f", q, "Die Protokolle werden nur für den Dienst und nicht für die Tabelle aufbewahrt.", None, ""), ("g", q, "It keeps them for 9 days. After that the archive moves all of the ta", None, ""),
             ("h", "What does this passage say about Foo?", "It keeps them for 9 days.", None, "yes"), ("i", q, None, False, ""), ("j", None, None, None, "")]
    many = cases + [(f"x{i}", q, f"It keeps them for {i} days.", None, "yes") for i in range(60)]
    df = spark.createDataFrame(many + cases[:1], "key string, question string, answer string, answerable boolean, passage string")
    got = {r.key: r.defect for r in pair_defects.single_defect(pair_defects.defects(df)).collect()}
    assert got == {"b": "empty", "c": "empty", "d": "echo", "e": "refusal", "f": "language", "g": "truncated", "h": "dependent", "j": "empty"}
    assert pair_defects.defects(df.limit(0)).count() == 0


def test_personal_data(spark):
    segmenter, model = personal_data.trained(["Alba", "Brenn"], ["Torvik", "Queld"], 500, 3)
    texts = personal_data.training_texts(["Alba", "Brenn"], ["Torvik", "Queld"], 150, random.Random(5))
    hit = miss = extra = 0
    for text, gold in texts:
        found = set(personal_data.found_in(text, segmenter, model))
        hit, miss, extra = hit + len(found & gold), miss + len(gold - found), extra + len(found - gold)
    assert hit >= 0.95 * (hit + miss) and hit >= 0.95 * (hit + extra)
    df = spark.createDataFrame([("a", "Signed, Alba Torvik. Mail alba@example.com"), ("b", None), ("c", "")], "key string, text string")
    parts = spark.createDataFrame([("Alba", "given"), ("Torvik", "family")], "name_part string, part_kind string")
    out = {r.key: r.redacted for r in personal_data.find_personal_data(df, parts).collect()}
    assert out == {"a": "Signed, [NAME]. Mail [EMAIL]", "b": None, "c": ""}


def test_names_without_a_listed_part_are_found():
    segmenter, model = personal_data.trained(["Alba", "Brenn"], ["Torvik", "Queld"])
    for text, name in (("Signed, V. Medzork.", "V. Medzork"), ("Thanks to Vuck Haezeclad for the patch.", "Vuck Haezeclad"), ("Dank an Kenquyx Dreinex für die Korrektur.", "Kenquyx Dreinex"), ("Signed, alba medzork.", "alba medzork")):
        assert personal_data.found_in(text, segmenter, model) == [(text.index(name), text.index(name) + len(name), "NAME")]
    for text in ("The Rolnir gateway keeps the rows.", "Der Konnektor Drythzeid liest die Zeilen.", "# Quarterly Report\nWhen Misquun is disabled, the team waits."):
        assert personal_data.found_in(text, segmenter, model) == []


def test_cutoffs_hold_on_other_pairs(spark):
    made = pair_samples.composed_pairs(1500, random.Random(404))
    rows = [(f"k{i}", q, a, None, p) for i, (q, a, p, _) in enumerate(made)]
    df = spark.createDataFrame(rows, "key string, question string, answer string, answerable boolean, passage string")
    found = {r.key: r.defect for r in pair_defects.single_defect(pair_defects.defects(df)).collect()}
    for d in pair_defects.DEFECTS:
        true = {f"k{i}" for i, x in enumerate(made) if x[3] == d}
        said = {k for k, x in found.items() if x == d}
        assert len(true & said) >= 0.85 * len(true) and len(true & said) >= 0.85 * len(said), (d, len(true), len(said), len(true & said))


def test_all_name_parts_count(spark):
    parts = spark.createDataFrame([(f"F{i}", "family") for i in range(30)] + [(f"G{i}", "given") for i in range(3)], "name_part string, part_kind string")
    given, family = personal_data.name_parts(parts)
    assert len(given) == 3 and len(family) == 30
    with pytest.raises(ValueError):
        personal_data.name_parts(parts, 10)


def test_packing_joins_large_side_tables(spark, monkeypatch):
    monkeypatch.setattr(packing, "SENT", 0)
    monkeypatch.setattr(packing, "A_SALT", 5)
    test_packing(spark)


def test_packing(spark):
    rng = random.Random(6)
    sizes = [rng.choice([rng.randint(1, 60), 512, 700, 0]) for _ in range(800)]
    items = spark.createDataFrame(list(enumerate(sizes)), "key long, n_tokens int")
    out = packing.pack(items, 512)
    assert out.agg(F.sum("n_tokens")).first()[0] == sum(sizes)
    fill = out.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert max(r.n for r in fill) <= 512 and sum(r.n for r in fill) / (512 * len(fill)) > 0.95
    split = {r.key for r in out.where("piece_no > 0").collect()}
    assert split == {i for i, n in enumerate(sizes) if n > 512}
    assert packing.pack(items.limit(0), 512).count() == 0


def test_mixing(spark):
    items = spark.createDataFrame([(i, " Big " if i % 5 else "small", 10 + i % 7) for i in range(3000)] + [(9999, None, 5)], "key long, source string, n_tokens int")
    targets = spark.createDataFrame([("big", 0.5, 2), ("SMALL", 0.4, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixture, shares = mixing.mix(items, targets)
    s = {r.source: r for r in shares.collect()}
    assert abs(s["big"].actual_share - 5 / 9) < 0.02 and s["none"].actual_share == 0.0
    assert mixture.groupBy("key").count().agg(F.max("count")).first()[0] <= 3
    assert abs(mixing.capped_mean(mixing.rate_for(1.7, 3), 3) - 1.7) < 1e-6


def test_mixing_whole_size(spark):
    items = spark.createDataFrame([(i, "big", 10) for i in range(2000)] + [(9000 + i, "tiny", 10) for i in range(20)], "key long, source string, n_tokens int")
    targets = spark.createDataFrame([("big", 0.8, 2), ("tiny", 0.2, 2)], "source string, target_share double, max_repeats int")
    small = {r.source: r for r in mixing.mix(items, targets)[1].collect()}
    assert small["tiny"].at_cap and small["big"].mixture_of_targeted < 0.12
    whole = {r.source: r for r in mixing.mix(items, targets, whole=True)[1].collect()}
    assert whole["tiny"].at_cap and not whole["big"].at_cap and whole["big"].source_tokens == 20_000
    assert whole["big"].mixture_of_targeted > 0.75 and whole["tiny"].most_repeats <= 2


def test_truncation(spark):
    rng = random.Random(7)
    full = [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(12)).capitalize() + "." for _ in range(400)]
    long = [" ".join(full[i : i + 9]) for i in range(0, 390, 3)]
    rows = [(i, "Desk", t[:300]) for i, t in enumerate(long)] + [(1000 + i, "wiki", t) for i, t in enumerate(long)] + [(2000, "wiki", None), (2001, None, ""), (2002, "wiki", full[0] + " The old gat"), (2003, "wiki", "Notes\n- one\n- two")]
    df = spark.createDataFrame(rows, "key long, source string, text string")
    cut = {r.key for r in truncation.truncated(df).where("cut").collect()}
    assert {i for i, t in enumerate(long) if not t[:300].rstrip().endswith(".")} <= cut
    open_end = spark.createDataFrame([(1, "wiki", "See also the handbook section on refunds and the"), (2, "wiki", "See also Brin, Dask")], "key long, source string, text string")
    assert {r.key for r in truncation.truncated(open_end).where("cut").collect()} == {1}
    assert 2002 in cut and 2003 not in cut and not any(1000 <= k < 2000 for k in cut)
    assert truncation.truncated(df.limit(0)).count() == 0
