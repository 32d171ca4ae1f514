"""Line dedup, mixing, decontamination, near-duplicates and language on odd rows."""

from __future__ import annotations

import random
import time
import zlib
from collections import Counter, defaultdict

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanrate.llm import bbit_minhash, feistel
from spanrate.llm import line_bitmaps as line_module
from spanrate.llm.bbit_minhash import drop_near_duplicates, near_duplicates
from spanrate.llm.components import connected_components
from spanrate.llm.cross_parsing import drop_unidentified, identify_languages, learnable, suffix_automaton
from spanrate.llm.line_bitmaps import _occurrences, drop_lines, line_bitmaps
from spanrate.llm.positional_index import contamination, phrase_matches, proximity_matches
from spanrate.llm.systematic_mix import mixed_documents, systematic_copies
from spanrate.llm.text import text_key


def test_lines_are_shuffled_once(spark, make_docs, odd_rows):
    plan = line_plan(_occurrences(make_docs(odd_rows), "doc_id", "text", 20))
    assert plan.count("Exchange") == 1 and "Exchange rangepartitioning(key" in plan and plan.count("Sort [") == 1


def line_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def common_lines():
    """Lines in 3 and in 300 documents of 64 salts, one twice in each; ids that are null and repeated."""
    rare, common = "a line of only three documents", "the line that every document has"
    texts = [(i, f"{common}\nown line of the document {i}\n{common.upper()}") for i in range(300)]
    texts += [(i, f"{rare}\n{common}\nshort") for i in (300, 301, 302, None)]
    texts += [(7, f"{common}\nanother text of seven"), (8, texts[8][1])]
    return [(i, t, "en", "a") for i, t in texts]


def test_lines_are_never_broadcast(make_docs, common_lines, monkeypatch):
    kept = {}
    real = line_module.keep
    monkeypatch.setattr(line_module, "keep", lambda df, name: kept.setdefault(name, (line_plan(df), real(df, name)))[1])
    plans = [line_plan(run(make_docs(common_lines))) for run in (line_bitmaps, drop_lines)] + [kept["dropped-lines"][0]]
    assert [("SortMergeJoin" in p, "Broadcast" in p) for p in plans] == [(True, False)] * 3


def test_line_stage_broadcasts_nothing(spark, make_docs, common_lines, monkeypatch):
    plans = []
    real = line_module.keep
    monkeypatch.setattr(line_module, "keep", lambda df, name: (plans.append(line_plan(df)), real(df, name))[1])
    plans.append(line_plan(corpus_pipeline.line_dedup(spark, make_docs(common_lines), "")))
    assert len(plans) == 4 and not any("Broadcast" in p for p in plans)


def test_repeated_lines_have_the_salts_of_their_documents(make_docs, common_lines):
    occurrences = _occurrences(make_docs(common_lines), "doc_id", "text", 20)
    wanted = {(bytes(r["key"]), r["salt"]) for r in occurrences.collect()}
    salted = line_module._salted(line_module._repeated(occurrences, 3)).collect()
    found = [(bytes(r["key"]), r["salt"]) for r in salted]
    per_key = Counter(key for key, _ in found)
    assert len(found) == len(set(found)) and set(found) == {(k, s) for k, s in wanted if k in per_key}
    assert sorted(per_key.values())[0] <= 4 and max(per_key.values()) > 60 and len(per_key) == 2


def test_common_lines_equal_brute_force(make_docs, common_lines):
    found = Counter((r["doc_id"], r["n_dropped"], r["kept_text"]) for r in line_bitmaps(make_docs(common_lines)).collect())
    pairs = [(r[0], r[1]) for r in common_lines]
    wanted = Counter((i, n, t) for (i, _), (_, n, t) in zip(pairs, brute.drop_lines(pairs), strict=True))
    assert found == wanted


def test_line_bitmaps_equal_brute_force(make_docs, odd_rows):
    found = Counter(
        (r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"])
        for r in line_bitmaps(make_docs(odd_rows)).collect()
    )
    pairs = [(r[0], r[1]) for r in odd_rows]
    wanted = Counter((i, *rest) for (i, _), rest in zip(pairs, brute.drop_lines(pairs), strict=True))
    assert found == wanted


def test_keep_runs_name_the_kept_lines(make_docs):
    line = "a line that is long enough"
    docs = make_docs([(i, f"head {i}\n{line}\nmid\n{line}\ntail", "en", "a") for i in range(4)])
    runs = {r["doc_id"]: [tuple(x) for x in r["keep_runs"]] for r in line_bitmaps(docs).collect()}
    assert runs[3] == [(0, 4)]
    assert runs[0] == [(0, 0), (2, 2), (4, 4)]


def test_drop_lines_keeps_columns_and_untouched_nulls(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    out = drop_lines(docs)
    assert out.columns == docs.columns
    assert out.where("doc_id = 4").first()["text"] is None
    assert out.count() == len(odd_rows)


def test_empty_tables(make_docs, spark):
    docs = make_docs([])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert line_bitmaps(docs).count() == 0
    assert near_duplicates(docs).count() == 0
    assert systematic_copies(docs).count() == 0
    assert contamination(docs, bench).count() == 0
    assert identify_languages(docs, docs).count() == 0
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, "").count() == 0


def test_mix_meets_targets(make_docs, words):
    draw = random.Random(3)
    sizes = [int(draw.paretovariate(1.1) * 5) % 900 for _ in range(1500)]
    rows = [
        (i, " ".join(draw.choices(words, k=n)), "en", draw.choice(["a", "a", "a", "b", "c", None]))
        for i, n in enumerate(sizes)
    ]
    out = systematic_copies(make_docs(rows)).collect()
    again = systematic_copies(make_docs(rows[::-1]).repartition(3)).collect()
    key = lambda r: (r["doc_id"], r["copies"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    total = Counter()
    for r in out:
        total[r["source_key"]] += r["size"]
    weights = dict(zip(sorted(total), (3, 1, 2, 3), strict=True))
    want = plain_targets(total, weights)
    taken = Counter()
    for r in out:
        assert r["size"] == sizes[r["doc_id"]]
        assert r["target"] == pytest.approx(want[r["source_key"]])
        assert 0 <= r["copies"] <= 2
        taken[r["source_key"]] += r["copies"] * r["size"]
    for s, t in want.items():
        assert taken[s] == pytest.approx(t, rel=0.05)


def plain_targets(total, weights):
    """Share out, stop at twice the size, share the excess again."""
    left, open_, target = 1.5 * sum(total.values()), set(total), {}
    while True:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > 2 * total[s]}
        if not over:
            return target | {s: left * weights[s] / w for s in open_}
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= over


def test_mixed_documents_on_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows).withColumn("copy_no", F.lit("clash"))
    out = mixed_documents(docs).collect()
    per_row = Counter((r["doc_id"], r["text"], r["source"]) for r in out)
    counts = defaultdict(int)
    for r in systematic_copies(make_docs(odd_rows)).collect():
        counts[r["doc_id"]] += r["copies"]
    emitted = Counter()
    for (i, _, _), n in per_row.items():
        emitted[i] += n
    assert {i: n for i, n in counts.items() if n} == dict(emitted)
    assert max(r["copy_no"] for r in out) <= 2


def test_contamination_equals_brute_force(make_docs, odd_rows, words, spark):
    draw = random.Random(8)
    passage = draw.choices(words, k=25)
    rows = [
        *odd_rows,
        (20, " ".join(words[:5] + passage[:12] + words[5:9]), "en", "a"),
        (21, ". ".join(passage[8:25]).upper(), "en", "a"),
        (22, " ".join(passage[:9]), "en", "a"),
        (23, " ".join(passage[:10] * 3), "en", "a"),
        (24, "short item", "en", "a"),
    ]
    items = [(0, " ".join(passage)), (1, "Short, item!"), (2, None), (3, "..."), (1, "é one"), (10, " ".join(passage[:15])), (None, "changed")]
    found = {
        (r["doc"], r["version"]): (r["n_hit"], r["item_ids"])
        for r in contamination(make_docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    }
    wanted = brute.contamination([r[1] for r in rows], items)
    got = Counter((k[0], v[0], tuple(v[1])) for k, v in found.items())
    want = {(r[0], n, tuple(ids)) for r, (_, n, ids) in zip(rows, wanted, strict=True) if n}
    assert set(got) == want


def test_phrase_runs_and_proximity(make_docs, words, spark):
    item = words[100:112]
    far = words[100:106] + words[:40] + words[106:112]
    docs = make_docs([
        (1, " ".join(words[:7] + item), "en", "a"),
        (2, " ".join(reversed(item)), "en", "a"),
        (3, " ".join(far), "en", "a"),
    ])
    items = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    runs = {r["doc"]: [tuple(x) for x in r["runs"]] for r in phrase_matches(docs, items).collect()}
    assert runs == {1: [(7, 19)]}
    near = proximity_matches(docs, items, n_terms=12, span=12).collect()
    assert {(r["doc"], r["item_id"], r["first"], r["last"]) for r in near} == {(1, "5", 7, 18), (2, "5", 0, 11)}


def test_search_does_not_depend_on_broadcasts(make_docs, odd_rows, words, spark):
    items = spark.createDataFrame([(1, " ".join(odd_rows[0][1].split()[5:30]))], "item_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    first = contamination(make_docs(odd_rows), items).orderBy("doc", "version").collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert contamination(make_docs(odd_rows), items).orderBy("doc", "version").collect() == first
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert first


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(make_docs, words, width, monkeypatch):
    """A large group of edited copies, chains, exact copies, odd rows; blocks of a few members."""
    monkeypatch.setattr(bbit_minhash, "MEMBER_BLOCK", 16)
    monkeypatch.setattr(bbit_minhash, "QUERY_BLOCK", 4)
    draw = random.Random(width)
    texts = {}
    base = draw.choices(words, k=120)
    for i in range(150):
        own = list(base)
        for _ in range(draw.randint(0, 9)):
            own[draw.randrange(120)] = draw.choice(words)
        texts[i] = " ".join(own)
    chain = draw.choices(words, k=80)
    for i in range(200, 220):
        chain[draw.randrange(80)] = draw.choice(words)
        chain[draw.randrange(80)] = draw.choice(words)
        texts[i] = " ".join(chain)
    for i in range(300, 340):
        texts[i] = " ".join(draw.choices(words, k=50))
    texts |= {400: texts[7].upper(), 401: texts[7].replace(" ", "\n"), 402: "one", 403: "ONE", 404: None, 405: "", 406: " "}
    found = near_duplicates(make_docs([(i, t, "en", "a") for i, t in texts.items()]), width=width).collect()
    wanted = brute.components(texts, width)
    assert {r["doc_id"]: r["component_id"] for r in found} == wanted
    for r in found:
        assert r["n_shingles"] == len(brute.shingles(texts[r["doc_id"]], width))
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_on_odd_rows(make_docs, odd_rows):
    found = near_duplicates(make_docs(odd_rows)).collect()
    assert len(found) == len(odd_rows)
    by_id = defaultdict(set)
    for r in found:
        by_id[r["doc_id"]].add((r["component_id"], r["kept"]))
    assert by_id[None] == {(None, True)}
    assert by_id[2] == by_id[3] == {(1, False)}
    assert by_id[5] == {(5, True)}
    out = drop_near_duplicates(make_docs(odd_rows))
    ids = [r["doc_id"] for r in out.collect()]
    assert 2 not in ids and 3 not in ids and ids.count(13) == 1 and None in ids


def test_dropping_near_duplicates_tells_rows_of_an_id_apart(make_docs, words):
    draw = random.Random(21)
    a, b, c, d = ([draw.choice(words) for _ in range(90)] for _ in range(4))
    near = lambda text: " ".join([*text[:-1], "changed"])
    a, b, c, d = (" ".join(x) for x in (a, b, c, d))
    rows = [(3, a), (7, near(a.split())), (7, b), (9, near(b.split())), (9, near(b.split())), (None, a)]
    out = drop_near_duplicates(make_docs([(i, t, "en", "a") for i, t in rows]))
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter([(3, a), (7, b), (None, a)])
    # One id leads two groups: the other group goes to its next id.
    rows = [(1, c), (1, d), (2, near(c.split())), (4, near(d.split())), (4, near(d.split()))]
    out = drop_near_duplicates(make_docs([(i, t, "en", "a") for i, t in rows])).collect()
    assert len(out) == 2 and len({r["doc_id"] for r in out}) == 2
    assert {r["text"].split()[0] for r in out} == {c.split()[0], d.split()[0]}


def test_estimate_is_corrected_for_chance(spark):
    import numpy as np

    draw = np.random.default_rng(4)
    rows, truth = [], []
    for shared in (0, 200, 400, 480):
        pool = draw.integers(0, 2**63, 1000 - shared, dtype=np.uint64)
        a, b = pool[:500], pool[500 - shared :]
        truth.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        rows.append([bbit_minhash.packed(bbit_minhash.minima(np.unique(x))).tolist() for x in (a, b)])
    frame = spark.createDataFrame(rows, "a array<long>, b array<long>")
    found = [r[0] for r in frame.select(bbit_minhash.estimate(F.col("a"), F.col("b"))).collect()]
    assert found == pytest.approx(truth, abs=0.15)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    found = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}


def test_suffix_automaton_spells_every_stretch():
    text = b"abracadabra banana"
    after = suffix_automaton(text)

    def known(x):
        state = 0
        for byte in x:
            if byte not in after[state]:
                return False
            state = after[state][byte]
        return True

    assert all(known(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1))
    assert not known(b"abb") and not known(b"z")


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = identify_languages(docs, learnable(docs)).join(docs.select("doc_id", "lang", "text"), "doc_id")
    rest = found.join(learnable(docs).select("doc_id"), "doc_id", "left_anti").collect()
    assert len(rest) > 40
    assert sum(r["lang"] == r["lang_pred"] for r in rest) / len(rest) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rest)


def test_language_on_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    found = defaultdict(set)
    for r in identify_languages(docs, docs).collect():
        found[r["doc_id"]].add((r["lang_pred"], r["score"] == 0))
    for i in (4, 5, 6, 12):
        assert found[i] == {("und", True)}
    assert found[14] == {("de", False)}
    none = identify_languages(docs, docs.where("lang = 'xx'")).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    kept = drop_unidentified(docs)
    assert kept.columns == docs.columns
    assert {4, 5, 6, 12}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_text_in_no_learned_language_is_dropped_and_unlabelled_text_is_not(make_docs, words):
    draw = random.Random(17)
    clean = [(i, " ".join(draw.choices(words, k=60)), "en", "a") for i in range(300)]
    noise = [(1000 + i, "".join(draw.choice("klmnopqrstuvwxyz ") for _ in range(300)), None, "a") for i in range(5)]
    noise.append((1100, "Съешь же ещё этих мягких французских булок да выпей чаю. " * 4, None, "a"))
    empty = [(1200, None, None, "a"), (1201, "12 34 !", None, "a")]
    short = [(1300, words[0], None, "a")]
    kept = {r["doc_id"] for r in drop_unidentified(make_docs(clean + noise + empty + short)).collect()}
    assert kept == {*range(300), 1300}
    bare = [(i, t, None, s) for i, t, _, s in clean[:20] + noise + empty]
    kept = {r["doc_id"] for r in drop_unidentified(make_docs(bare)).collect()}
    assert kept == {*range(20), *(r[0] for r in noise)}


def test_phrase_bound_is_measured_on_all_labelled_texts(spark, make_docs, words):
    """Most labelled texts are dense; the 256 with the smallest hashes, measured alone, are not."""
    draw = random.Random(23)
    plain = [" ".join(draw.choices(words, k=60)) for _ in range(600)]
    dense = ["".join(draw.choice("klmnopqrstuvwxyz ") for _ in range(300)) for _ in range(800)]
    frame = spark.createDataFrame([(t,) for t in plain + dense], "text string")
    hashes = {r[0]: r[1] for r in frame.select("text", text_key(F.col("text"))).collect()}
    plain = sorted(plain, key=hashes.get)[:270]
    dense = [t for t in dense if hashes[t] > hashes[plain[-1]]]
    assert len(dense) > 330
    learned = (i for i in range(10_000) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows = [(i, t, "en", "a") for i, t in zip(learned, plain + dense, strict=False)]
    kept = {r["text"] for r in drop_unidentified(make_docs(rows), texts=4).collect()}
    assert kept == {t for _, t, *_ in rows}


def test_pipeline_equals_brute_force(spark, make_docs, odd_rows, words, tmp_path):
    passage = " ".join(words[200:240])
    rows = [r for r in odd_rows if r[0] is not None]
    rows += [(50, "lead in " + passage, "en", "a"), (51, "clean words only here", "en", "b")]
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    make_docs(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    results = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        results.append(docs)
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    state = [(i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t)]
    assert Counter((r["doc_id"], r["text"]) for r in results[0].collect()) == Counter(state)
    state = [(i, t) for (i, _), (_, _, t) in zip(state, brute.drop_lines(state), strict=True)]
    assert Counter((r["doc_id"], r["text"]) for r in results[1].collect()) == Counter(state)
    near = {r["doc_id"] for r in results[2].collect()}
    assert {1, 7, 13, 14, 50, 51} <= near and not {2, 3} & near
    assert results[2].count() == len(near)
    assert {r["doc_id"] for r in results[3].collect()} == near - {50}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda r: (r["doc_id"], r["copy_no"])
    assert sorted(map(key, whole.collect())) == sorted(map(key, results[4].collect()))


CLASHES = "__t __v __d __none __lines __gone __runs __s __n __c __id __version __source __copies __doc __twice __size".split()
CLASHES += "__phrases lang_pred row gone twice doc version node part kept windows".split()


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_named_like_their_own(spark, odd_rows, stage, tmp_path):
    rows = [(i, t, lang, source, 0, *[f"{c}{i}" for c in CLASHES]) for i, t, lang, source in odd_rows]
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
    schema = "doc_id long, text string, lang string, source string, n_chars long, "
    docs = spark.createDataFrame(rows, schema + ", ".join(f"{c} string" for c in CLASHES))
    spark.createDataFrame([("b1", "none of these words is anywhere")], "item_id string, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    run = dict(corpus_pipeline.STAGES)[stage]
    found = run(spark, docs, str(tmp_path))
    assert found.columns[: len(names)] == names
    kept = found.collect()
    assert kept and all(r[c] == f"{c}{r.doc_id}" for r in kept for c in CLASHES)
    plain = docs.select(*names[:5])
    bare = run(spark, plain, str(tmp_path)).select("doc_id", "text").collect()
    assert sorted(map(str, bare)) == sorted(str(r) for r in found.select("doc_id", "text").collect())
    assert run(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_very_many_values_are_found_in_time():
    f = feistel.Feistel(b"k")
    text = " ".join(f"user{i}@example.com" for i in range(30_000))
    begin = time.monotonic()
    replaced, spans = feistel.find_and_replace(f, text)
    assert time.monotonic() - begin < 20 and len(spans) == 30_000
    assert feistel.find_and_replace(f, replaced, back=True)[0] == text
