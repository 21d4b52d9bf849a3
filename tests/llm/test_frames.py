"""Corpus operators and pipeline stages on frames: brute force, and odd rows in every one of them."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from peakloom.llm import dedup, langid, media, mixing, packing, pages, pii, quality, queries, rules, tokens
from peakloom.llm.graph import components
from tests.llm.test_values import WORD, _base_slowly, _shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `size` string, `count` int, `__text` string, `spans` int, `taken` int, `a.b` int"


def _words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "and", "ship", "sails", "over", "sea.", "home.", "quiet", "green", "to", "in", "bright", "stone"]) + (str(r.randrange(50)) if r.random() < 0.5 else "") for _ in range(n))


def _texts():
    base = _words(0, 120)
    near = base.split(" ")
    near[60] = "changed"
    texts = [None, "", " \n\t", "a", "mail a@b.co card 4845168114407329", base, base, " ".join(near), base + " tail", _words(1, 20_000), "x" * 100_000, "é" * 700]
    texts += [_words(i, 60 + i) for i in range(2, 30)] + ["### $$$ *** !!! " * 40, "same words here now " * 40, "BUY NOW!! " * 60]
    return texts


def _rows():
    rows = [(i if i != 7 else None, t, [None, "en", "fr"][i % 3], [None, "b", "a", "hot", "hot"][i % 5], len(t or ""), "s", 1, "t", 2, 3, 4) for i, t in enumerate(_texts())]
    return rows + rows[5:8] + [(None, None, None, None, None, None, None, None, None, None, None)] * 2


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _key(x):
    return tuple((v is not None, v) for v in x)


def _same(got, want):
    assert sorted(map(tuple, got), key=_key) == sorted(map(tuple, want), key=_key)


def _figures_slowly(text):
    text = text or ""
    w = WORD.findall(text)
    seen, covered = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered |= {p + k for p in places for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rules(docs, empty):
    got = rules.quality_rules(docs).collect()
    _same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], [(r[0], *_figures_slowly(r[1])) for r in _rows()])
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept) and 0 <= r.p_good <= 1
    assert rules.quality_rules(empty).count() == 0


def test_rules_against_labels(spark):
    """The fit sees no label. Of labelled texts that pass the base rule it keeps the good and drops the bad, and its verdict
    is neither that of the untrained model nor all-must-pass."""
    path = "/root/testdata/sf0.1"
    figured = rules.figures(spark.read.parquet(f"{path}/documents.parquet")).cache()
    model = rules.fit(figured)
    labels = spark.read.parquet(f"{path}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = rules.judge(figured, model).join(labels, "doc_id", "left").where("not base_failed")
    one_bad = F.least(*rules.votes().values()) < 0
    got = {(r.quality, r.kept, r.bad): r["count"] for r in own.groupBy("quality", "kept", one_bad.alias("bad")).count().collect()}
    n = lambda quality, kept: sum(v for k, v in got.items() if k[:2] == (quality, kept))
    assert n(1, True) >= 0.99 * (n(1, True) + n(1, False)) and n(0, False) >= 0.99 * (n(0, True) + n(0, False))
    assert sum(v for (_, kept, bad), v in got.items() if kept and bad) > 0
    start = rules.VoteModel()
    p = lambda m: [r[0] for r in figured.orderBy("doc_id").select(F.round(m.posterior(), 9)).collect()]
    assert sum(a != b for a, b in zip(p(model), p(start), strict=True)) > 9_000


def test_repeated_words(spark):
    r = random.Random(9)
    texts = [" ".join(r.choice("abcd") for _ in range(r.randrange(40))) for _ in range(150)] + ["a b c\na b c\n\na b c", "  a  b\x0bc \x0c"]
    got = rules.figures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x.doc_id: tuple(x[k] for k in rules.FIGURES) for x in got} == {i: _figures_slowly(t) for i, t in enumerate(texts)}


def test_pii(docs, empty):
    got = pii.pii_digest(pii.find_pii(docs)).collect()
    want = []
    for r in _rows():
        spans = _base_slowly(r[1] or "")
        n = [sum(s[2] == k for s in spans) for k in pii.BASE]
        want.append((r[0], *n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()))
    _same([tuple(r)[:6] for r in got], want)
    assert all(r.n_spans == len([x for x in r.spans.split(",") if x]) and r.has_personal_data == (r.n_spans > 0) == (r.top_score is not None) for r in got)
    assert pii.pii_digest(pii.find_pii(empty)).count() == 0


def test_tokens(docs, empty):
    library = tokens.counter(tokens.default_tokenizer()).library
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    got = tokens.token_counts(docs).collect()
    _same([tuple(r)[:4] for r in got], [(r[0], len((r[1] or "").encode()), n(r[1]), n(r[1]) > 1024) for r in _rows()])
    of = {r.doc_id: r.fit_chars for r in got if r.doc_id is not None}
    for i, text in ((r[0], r[1] or "") for r in _rows() if r[0] is not None):
        assert n(text[: of[i]]) <= 1024 and (of[i] == len(text) or n(text[: of[i] + 1]) > 1024)
    stored = tokens.prefix_tables(docs).where("doc_id = 9").first()
    assert tokens.PrefixTable.from_steps(stored.steps).at(1000) == n(_rows()[9][1][:1000])
    assert tokens.token_counts(empty).count() == 0
    assert all(r.n_tokens <= 5 for r in tokens.truncated(docs.limit(4), 5).collect())


def test_media(docs, empty):
    got = media.media_digest(docs).collect()
    want = []
    for r in _rows():
        data = (r[1] or "").encode()
        padded = data + b"\xff" * ((-len(data)) % 576 if data else 576)
        want.append((r[0], len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])))
    _same([tuple(r)[:5] for r in got], want)
    files = media.describe(media.to_media(docs))
    assert files.where("codec is null or track <> 0 or fragmented").count() == 0 and files.count() == len(_rows())
    odd = media.describe(docs.select("doc_id", F.when(F.col("doc_id") > 3, F.col("text").cast("binary")).alias("media")))
    assert odd.where("codec is null").count() == len(_rows())
    assert media.media_digest(empty).count() == 0


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    sizes = {}
    for r in _rows():
        sizes.setdefault(r[3], []).append(len(WORD.findall(r[1] or "")))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    total, weight, full = sum(map(sum, sizes.values())), {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}
    while True:
        rest, open_ = total - sum(full.values()), sum(weight[s] for s in names if s not in full)
        over = [s for s in names if s not in full and rest * weight[s] / open_ > 3 * sum(sizes[s])]
        if not over:
            break
        full |= {s: 3 * sum(sizes[s]) for s in over}
    target = {s: full.get(s, rest * weight[s] / open_) for s in names}
    taken = dict.fromkeys(names, 0)
    for r in got:
        assert r.source_size == sum(sizes[r.source]) and math.isclose(r.target, target[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(sizes[s]) for s in names) and len(got) == len(_rows())
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=_key) == sorted(map(tuple, got), key=_key)
    assert mixing.mix(empty).count() == 0


def test_mix_of_copies(spark):
    rows = [(None, "a b c", "x")] * 500 + [(1, "a b c d", "y")] * 100
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in "xy":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4


def test_packing(docs, empty):
    own = packing.encoder(tokens.default_tokenizer()).library
    got = packing.pack(docs).toPandas()
    want = []
    for r in _rows():
        ids = np.array([*own.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        edges = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want += [(r[0], i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    _same([(None if r[0] != r[0] else int(r[0]), *map(int, r[1:])) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)], want)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 2048) + 1
    assert packing.pack(empty).count() == 0


def test_ranks_in_salted_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 3)
    rows = spark.range(200).select("id", (F.col("id") % 3).alias("k"))
    got = packing.ranked(rows, "k", "id", {0: 67, 1: 67, 2: 66}).collect()
    for k in range(3):
        assert sorted(r["rank"] for r in got if r.k == k) == list(range(len([r for r in got if r.k == k])))


def _components_slowly(rows):
    sets = [_shingles(r[1] or "") for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(root(i)), r[0] == least.get(root(i))) for i, r in enumerate(rows)]


def test_near_duplicates(docs, empty):
    _same(dedup.near_duplicates(docs).collect(), _components_slowly(_rows()))
    assert dedup.near_duplicates(empty).count() == 0


def test_chains_of_near_copies(spark, monkeypatch):
    """Groups around a centre, whose members are at the limit, in blocks far smaller than the group."""
    monkeypatch.setattr(dedup, "BLOCK", 8)
    r, rows = random.Random(8), []
    base = _words(99, 150).split(" ")
    for i in range(70):
        w = list(base)
        for _ in range(r.randrange(1, 9)):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    _same(got, _components_slowly(rows))


def test_components(spark):
    r = random.Random(6)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 160)] + [(5, 5)]
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}


def test_pages(spark, sf):
    rows = spark.createDataFrame([(1, "u", "<article><p>one<p>two</article>", 1), (None, None, None, 2), (3, "", "", 3)], "page_id long, url string, html string, text int")
    _same(pages.extract(rows).collect(), [(1, "u", "one two", 7), (None, None, "", 0), (3, "", "", 0)])
    assert pages.extract(rows.limit(0)).count() == 0
    # the fixture's own markup says what its article is; the operator doesn't read that pattern
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        import html as h

        plain = re.sub(r"\s+", " ", h.unescape(re.sub(r"<[^>]*$", "", re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", article))))).strip()
        assert pages.main_text(r.html) == plain


def test_language(spark, sf, docs, empty):
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.identify(whole).join(whole.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert got and sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)
    odd = langid.identify(docs).collect()
    assert len(odd) == len(_rows()) and all(r.lang_pred in ("en", "fr", "und") and 0 <= r.score <= 1 for r in odd)
    assert {r.held_out for r in odd if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2} == {True}
    assert langid.identify(empty).count() == 0


def test_quality(spark, docs, empty):
    path = "/root/testdata/sf0.01"
    whole, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(whole, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)
    own = docs.select("doc_id", F.lit(1).alias("quality"))
    odd = quality.classify(docs, own).collect()
    assert len(odd) == len(_rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in odd)
    assert {r.score for r in quality.classify(docs, own.limit(0)).collect()} == {0.5}
    assert quality.classify(empty, own).count() == 0


def test_quality_fit_equals_the_one_in_memory(spark, monkeypatch):
    """Sums in tasks and steps, over all rows, against the same fit of plain arrays."""
    monkeypatch.setattr(quality, "FAN", 2)
    path = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(quality.feature_table(docs.repartition(5)), labels)
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    rows = [(r.doc_id, quality.features(r.text or "").astype(float)) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    plain = quality.fit_features(np.stack([x for i, x in rows if i in good]), np.stack([x for _, x in rows]))
    assert model.prior == plain.prior and np.allclose(model.weights, plain.weights, atol=1e-3)


@pytest.mark.parametrize("ids", [None, 3, "many"])
def test_fits_on_null_and_repeated_ids(spark, ids):
    """Labelled rows whose ids are all null, or all the same, are still learned from."""
    texts = [(None if ids is None else 3 if ids == 3 else i, _words(i, 80) if i % 2 else " ".join(f"qu{k}ell zorp{i % 7}" for k in range(70)), "en" if i % 2 else "xx", 1) for i in range(1200)]
    rows = spark.createDataFrame(texts, "doc_id long, text string, lang string, other int")
    got = langid.identify(rows).join(rows.select(F.col("text").alias("t"), "lang").distinct(), F.lit(False), "left").select("lang_pred").groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in got} == {"en": 600, "xx": 600}
    labels = rows.where("lang = 'en'").select("doc_id", F.lit(1).alias("quality"), "text")
    out = quality.classify(rows, labels.union(labels))
    assert out.count() == 1200 and (ids is None) == (out.where("score = 0.5").count() == 1200)


@pytest.mark.parametrize("name", [k for k, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, docs, empty, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, "")
    if name != "packed_sequences":
        assert out.columns == docs.columns
    assert out.count() > 0 and stage(spark, empty, "").count() == 0


def test_rule_stage_keeps_what_the_operator_keeps(spark, docs):
    kept = rules.quality_rules(docs).where("kept").select("doc_id").collect()
    _same(corpus_pipeline.quality_rules(spark, docs, "").select("doc_id").collect(), kept)


def test_dedup_stage_keeps_one_of_each(spark, docs):
    out = [tuple(r) for r in dedup.keep_one(docs).select("doc_id", "text").collect()]
    texts = [t for _, t in out if t and WORD.search(t)]
    groups = {}
    for r, c in zip(_rows(), _components_slowly([(i, r[1]) for i, r in enumerate(_rows())]), strict=True):
        if r[1] and WORD.search(r[1]):
            groups.setdefault(c[2], []).append(r)
    assert len(texts) == len(groups) and len(out) == len(groups) + sum(not (r[1] and WORD.search(r[1])) for r in _rows())
    for g in groups.values():
        assert min(r[0] for r in g if r[0] is not None) in {d for d, _ in out}


def test_personal_data_stage(spark, docs):
    out = corpus_pipeline.personal_data(spark, docs, "")
    row = out.where("doc_id = 4").first()
    assert row.text == "mail <email> card <card>" and row.n_chars == len(row.text) and out.count() == len(_rows())


def test_mix_stage_repeats(spark, docs):
    copies = {}
    for r in mixing.mix(docs).where("taken > 0").collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    got = {r.doc_id: r["n"] for r in corpus_pipeline.source_mix(spark, docs, "").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == copies


def test_pipeline(spark, sf):
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert len(out) and out.groupby("sequence_id").length.sum().max() <= 2048
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_registered(spark):
    import __spark_entry__

    assert set(queries.queries()) | {"pipeline"} <= set(__spark_entry__.queries())
    assert [f"op{n}_" for n in range(1, 11)] == [m[0] for k in queries.queries() if (m := re.match(r"op\d+_", k))]
