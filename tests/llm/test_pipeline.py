"""The pipeline's stages, each against a brute-force version on what the stage before kept."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm import quality, simhash, toxicity, words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed=4):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioubdfgklmnprst") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    made = []
    for i in range(240):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        if i % 4 == 0:
            body[3:3] = ["zarkel", "zarkon"]
        made.append(" ".join(f"{w.upper()}!!" for w in body) if i % 3 == 0 else " ".join(body))
    clean = [t for i, t in enumerate(made) if i % 4 and i % 3]
    made += [clean[0], clean[1] + " ", clean[2] + " again", clean[3] + " mail bob.smith12@mail.example.com", "", None]
    return made


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, made = str(tmp_path_factory.mktemp("pipeline")), texts()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(made)], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    source = {r.doc_id: r.text for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "private_data", "packing"]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id: r for r in docs.collect()} if name != "packing" else docs.collect())
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    good, civil, single, private, packed = kept
    plain = lambda ids: [source[i] or "" for i in ids]
    score = quality.Scorer(quality.fit(*words.labelled_sample(spark, folder, "quality", 4, 2))).scores(plain(sorted(source)))
    assert set(good) == {i for i, s in zip(sorted(source), score) if s >= 0.7}
    score = toxicity.Scorer(toxicity.fit(*words.labelled_sample(spark, folder, "toxic", 3, 1))).scores(plain(sorted(good)))
    assert set(civil) == {i for i, s in zip(sorted(good), score) if s < 0.7}
    wanted = [i for i in range(240) if i % 3 and i % 4]
    assert len(set(wanted) & set(civil)) >= 0.97 * len(wanted) and len({i for i in civil if i < 240} - set(wanted)) <= 3
    expected = brute_near_duplicates({i: r.text or "" for i, r in civil.items()})
    assert set(single) == expected
    for i, r in private.items():
        assert (r.text == source[i]) == ("@" not in (source[i] or "")) and r.n_chars == len(r.text or "")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = {}
    for r in sorted(packed, key=lambda r: (r.doc_id, r.start)):
        by.setdefault(r.doc_id, []).extend(memoryview(bytes(r.ids)).cast("I").tolist())
    assert by == {i: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for i, r in private.items()}


def brute_near_duplicates(rows):
    def shingles(text):
        found = text.lower().split()
        return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()

    sets = {i: shingles(t) for i, t in rows.items()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    least = {i: i for i in rows}
    linked = [(i, j) for i in rows for j in rows if i < j and like(sets[i], sets[j]) >= 0.8]
    for _ in rows:
        for i, j in linked:
            least[i] = least[j] = min(least[i], least[j])
    return set(least.values())


def changed_copies(seed):
    """Texts and copies of them whose similarity is near 0.8, and short texts with a word more or another one."""
    rng = random.Random(seed)
    made = []
    for n in [400] * 40 + list(range(1, 40)):
        base = [f"w{rng.randrange(100_000)}" for _ in range(n)]
        made.append(base)
        made.append([*base, "more"])
        if n == 400:
            made[-1] = list(base)
            for at in range(rng.randint(7, 9)):
                made[-1][20 + 40 * at] = "new"
    return [" ".join(t) for t in made] + ["", " ", "a", "A", "a b", "a b  "]


def test_near_duplicates_at_the_threshold(spark):
    """Pairs of 0.8 and little more are linked, those of little less aren't, long or short."""
    rows = dict(enumerate(changed_copies(1)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], COLUMNS)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == brute_near_duplicates(rows)


def test_near_duplicates_that_meet_through_an_unlike_one(spark, monkeypatch):
    """Copies stay linked where the first of their bucket is unlike them, and where they never meet in a bucket."""
    monkeypatch.setattr(simhash, "TABLES", 1)
    rng, made = random.Random(2), []
    for _ in range(40):
        base = [f"w{rng.randrange(100_000)}" for _ in range(400)]
        for changes in (11, 0, 5):
            made.append(list(base))
            for at in range(changes):
                made[-1][(20 if changes == 5 else 10) + 35 * at] = "new"
    rows = {i: " ".join(t) for i, t in enumerate(made)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], COLUMNS)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == brute_near_duplicates(rows)


def test_near_duplicates_compare_few_pairs(spark, monkeypatch):
    """Of copies that all meet each other, no more pairs are compared than there are texts; all are linked, and unlike ones aren't."""
    compared, verified = [], simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    rng, made = random.Random(3), []
    for _ in range(4):
        base = [f"w{rng.randrange(100_000)}" for _ in range(400)]
        for _ in range(40):
            made.append(list(base))
            for _ in range(2):
                made[-1][rng.randrange(400)] = f"new{rng.randrange(100_000)}"
    rows = {i: " ".join(t) for i, t in enumerate(made)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], COLUMNS)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == brute_near_duplicates(rows)
    assert sum(compared) <= len(rows)


def test_odd_rows(spark, folder, tmp_path):
    """Null ids, repeated rows, extra columns and an empty table pass through every stage."""
    rows = [(None, "some words here", 1), (None, None, 2), (7, "some other words", 3), (7, "some other words", 3), (7, "quite different text now", 4)]
    docs = spark.createDataFrame([(i, t, "en", "s", 3, e) for i, t, e in rows], COLUMNS + ", _lectern_score long")
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, some, folder)
            if name != "packing":
                assert made.columns == some.columns, name
            n = made.count()
            assert n == 0 if some is not docs else n >= 0
    single = corpus_pipeline.near_duplicates(spark, docs, folder).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in single) == [("7", "quite different text now"), ("7", "some other words"), ("None", ""), ("None", "some words here")]
    assert corpus_pipeline.private_data(spark, docs, folder).count() == 5
