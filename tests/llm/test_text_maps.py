"""Operators that map each document by itself: personal data, pieces, classifiers."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskmap.llm import language_id, pieces, pii, quality, toxicity
from riskmap.llm.common import labelled_sample
from tests.llm import brute


def base(text, anchors=pii.automaton()):
    return [s for s in pii.spans(text, anchors) if s[0] in pii.BASE]


# ---- personal data

@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.+-_ 0123456789()%é:", max_size=60))
def test_pii_base_equals_the_patterns(text):
    assert base(text) == brute.pii(text)


@pytest.mark.parametrize("text", [
    "4111 1111 1111 1111", "4111-1111-1111-1111 x", "1.2.3.4.5.6.7.8", "1.2.3.256 999.1.1.1", "a@b@c.de.f",
    "a@b.c@d.e", "+1 2 3 4 5 6 7 8.", "++12345678", "1" * 9000, "1." * 3000, "a" * 5000 + "@x.y", "@" * 2000 + "a@b.c",
    "0" * 6000 + ".1.2.3"])
def test_pii_boundaries(text):
    if text.startswith("000"):  # a plain int() refuses so many digits
        assert base(text) == [("ip", 0, len(text))]
    else:
        assert base(text) == brute.pii(text)


def test_pii_added_kinds():
    found = pii.spans("IBAN: DE89 3704 0044 0532 0130 00, password=abc12345x; ssn 123-45-6789 ftp://u:pw@host.org "
                      "account no. 12345678 password is fine, token of thanks", pii.automaton())
    text = [s for s in found if s[0] in ("account", "secret")]
    assert len([s for s in text if s[0] == "account"]) == 4 and len([s for s in text if s[0] == "secret"]) == 1


def test_pii_table(odd, nothing, documents, texts):
    rows = pii.find_pii(odd, keep=["doc_id"]).collect()
    assert len(rows) == 12
    by = {r["doc_id"]: r for r in rows if r["doc_id"] != 4}
    assert by[1]["spans"] == "" and by[2]["n_email"] == 0 and by[5]["n_email"] == by[5]["n_phone"] == 1
    assert pii.find_pii(nothing).count() == 0
    clash = odd.withColumn("n_email", F.lit("x")).withColumn("Spans", F.lit(1))
    assert pii.find_pii(clash).schema["n_email"].dataType.simpleString() == "bigint"
    for r in pii.find_pii(documents, keep=["doc_id"]).collect():
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute.pii(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_pii_mask(odd):
    masked = {r["doc_id"]: r["masked"] for r in pii.mask_pii(odd).where("doc_id IN (1, 5)").collect()}
    assert masked == {1: None, 5: "mail [EMAIL] or [PHONE] now"}


# ---- pieces

@pytest.fixture(scope="module")
def model():
    return pieces.read_model()


def test_pieces_without_dropout_equal_the_library(model, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    coder = pieces.PieceCoder(model, dropout=0.0)
    for text in [*list(texts.values())[:60], "  two  spaces ", "a" * 300, "", "\t\n x", "日本語 ①"]:
        assert coder.encode(text) == library.encode(text)


def test_pieces_list_and_heap_agree(model):
    for dropout in (0.0, 0.2):
        coder = pieces.PieceCoder(model, dropout=dropout)
        for unit in ("▁information", "▁unbelievably", "▁Straßenbahn", "▁a\ud800b"):
            draws = coder._draws(unit, 1)
            ids = [coder.ids.get(c, -1) for c in unit]
            assert coder._merge_list(list(ids), draws) == coder._merge_heap(list(ids), draws)


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=80))
def test_pieces_round_trip(text):
    coder = test_pieces_round_trip.__dict__.setdefault("coder", None) or pieces.PieceCoder(pieces.read_model(), dropout=0.3)
    test_pieces_round_trip.coder = coder
    assert coder.decode(coder.encode(text)) == text


def test_pieces_vary_with_the_seed_only(model, texts):
    text = max(texts.values(), key=len)
    a, b, c = (pieces.PieceCoder(model, dropout=0.1, seed=s).encode(text) for s in (1, 1, 2))
    plain = pieces.PieceCoder(model, dropout=0.0).encode(text)
    assert a == b and a != c and len(plain) < len(a) < 2 * len(plain)


def test_pieces_draw_for_each_occurrence(model):
    coder = pieces.PieceCoder(model, dropout=0.1)

    def forms(ids):
        cuts = [i for i, x in enumerate(ids) if x == coder.byte_ids[10]]  # a line feed is no piece
        return {tuple(ids[a + 1:b]) for a, b in zip([-1, *cuts], cuts)}

    assert len(forms(coder.encode("information\n " * 300))) > 2
    assert len(set().union(*[forms(coder.encode(f"information\n {k}")) for k in range(300)])) > 2
    long = coder.encode("information" * 300)
    assert len({tuple(long[i:i + 40]) for i in range(0, len(long) - 40)}) > len(long) // 2


def test_pieces_rows_equal_single_merging(model, texts):
    for dropout in (0.0, 0.1, 0.5):
        coder = pieces.PieceCoder(model, dropout=dropout)
        many = [*list(texts.values())[:40], "", None, "  two  spaces ", "a" * 300 + " b", "日本 ①▁x \x00"]
        want = []
        for text in many:
            at = 0
            draws = coder._draws(text) if text and dropout else b""
            for unit in pieces._UNIT.findall("▁" + text.replace("▁", pieces._OWN).replace(" ", "▁")) if text else []:
                want += coder.unit_ids(unit, draws[3 * at:3 * (at + len(unit))])[1]
                at += len(unit)
        for _ in range(2):  # the cache changes nothing
            flat, sizes = coder.encode_all(many)
            assert flat.tolist() == want and sizes.sum() == len(want)


def test_pieces_table(odd, nothing, documents):
    encoded = pieces.encode_texts(odd.withColumn("n_tokens", F.lit("clash")))
    rows = pieces.decode_ids(encoded).collect()
    want = sorted((str(r["doc_id"]), r["text"] or "") for r in odd.collect())
    assert sorted((str(r["doc_id"]), r["decoded"] or "") for r in rows) == want
    null = next(r for r in rows if r["doc_id"] == 1)
    assert null["token_ids"] is None and null["decoded"] is None and null["n_tokens"] == 0
    assert pieces.encode_texts(nothing).count() == 0
    bad = (documents.join(pieces.encode_texts(documents, keep=["doc_id"]), "doc_id")
           .where(F.sha2("text", 256) != F.col("decoded_sha256")))
    assert bad.count() == 0


# ---- classifiers: held-out accuracy

def held_out(scored, labels, label):
    rows = scored.join(labels, "doc_id").collect()
    rows = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    return [(r[label], r["score"], r["predicted"]) for r in rows]


def test_quality_held_out(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    rows = held_out(quality.score_quality(docs, model, keep=["doc_id"]), labels, "quality")
    assert np.mean([y == p for y, _, p in rows]) > 0.95
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == quality.score_quality(docs, model).where("predicted = 1").count()


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = held_out(toxicity.score_toxicity(docs, toxicity.train(docs, labels), keep=["doc_id"]), labels, "toxic")
    assert np.mean([y == p for y, _, p in rows]) > 0.9


def test_toxicity_shares_subwords():
    clean = [f"the quiet garden number {w} is green" for w in ("one", "two", "three", "four", "five", "six")] * 6
    toxic = [f"the {w} garden is green" for w in ("worthless", "worthles", "wworthless", "worthlesss")] * 6
    model = toxicity.fit(clean + toxic, [0] * len(clean) + [1] * len(toxic))
    scores = model.score(["a worthlessss garden", "a quiet garden", " ".join(["green garden"] * 3000) + " worthlezss x"], {})
    assert scores[0] > 0.5 > scores[1] and scores[2] > 0.5


def test_additive_model_learns_a_pair_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.AdditiveModel().fit(x, y, rounds=20, n_pairs=1, pair_rounds=60)
    assert model.pairs == [(0, 1)] and np.mean((model.predict(x) > 0.5) == y) > 0.9


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify_language(docs, language_id.train(docs), keep=["doc_id", "lang"]).collect()
    rows = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


def test_language_batch_equals_single_texts():
    counts = {k: np.random.default_rng(i).integers(0, 9, 1 << language_id.BITS) for i, k in enumerate("ab")}
    model, letters = language_id.NaiveBayes(counts), language_id._letters()
    texts = ["Hello", "", None, "x", "12 .", "İstanbul ŒUVRE", "a b c"]
    together = model.score(texts, letters)
    assert together[0][1:3] == ["und", "und"] and together[0][4] == "und"
    for t, lang, score in zip(texts, *together):
        one = model.score([t], letters)
        assert one[0][0] == lang and abs(one[1][0] - score) < 1e-9


def test_classifiers_on_odd_rows(odd, nothing, labels):
    for train, score in ((quality.train, quality.score_quality), (toxicity.train, toxicity.score_toxicity)):
        model = train(odd, labels)
        rows = score(odd.withColumn("score", F.lit("clash")), model).collect()
        assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
        assert score(nothing, train(nothing, labels.limit(0))).count() == 0
        assert all(0 <= r["score"] <= 1 for r in score(odd, train(nothing, labels)).collect())
    rows = language_id.identify_language(odd.withColumn("lang_pred", F.lit(1)), language_id.train(odd)).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 12 and by[1]["lang_pred"] == by[3]["lang_pred"] == by[9]["lang_pred"] == "und"
    assert {r["lang_pred"] for r in language_id.identify_language(odd, language_id.train(nothing)).collect()} == {"und"}


def test_training_never_sees_the_held_out_class(documents, labels):
    ids = [r["_lid"] for r in labelled_sample(documents, labels, "toxic", "doc_id", "text", 10 ** 6).collect()]
    assert ids and all(zlib.crc32(str(i).encode()) % 5 for i in ids)


def test_training_text_is_bounded_on_large_tables(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 400 == 1, F.repeat(F.lit("long "), 100_000))
                                    .otherwise(F.repeat(F.lit("ab "), 1000)).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    whole = labelled_sample(docs, labels, "toxic", "doc_id", "text", 400).agg(F.sum(F.octet_length("text"))).first()[0]
    limit = 300_000  # a larger share of the picked bytes than 400 is of the rows
    assert limit < whole
    rows = labelled_sample(docs, labels, "toxic", "doc_id", "text", 400, limit).collect()
    assert limit * 0.9 < sum(len(r["text"]) for r in rows) <= limit and {r["y"] for r in rows} == {0, 1}
    assert len(labelled_sample(docs, labels, "toxic", "doc_id", "text", 400, whole).collect()) > len(rows)


# ---- linear time, cues in any case, rare classes

def test_pii_cues_in_any_case_and_long_credentials():
    anchors = pii.automaton()

    def found(text):
        return [(k, text[a:b]) for k, a, b in pii.spans(text, anchors)]
    assert found("Social Security number: 123-45-6789") == [("account", "123-45-6789")]
    assert found("Api_Key=abcd1234efgh") == [("secret", "abcd1234efgh")]
    assert found("IBan DE89 3704 0044 0532 0130 00") == [("account", "DE89 3704 0044 0532 0130 00")]
    user = "u" * 200
    assert ("account", f"{user}:pw") in found(f"ftp://{user}:pw@host.example:8080/x")
    assert ("address", "host.example:8080") in found(f"ftp://{user}:pw@host.example:8080/x")
    assert found("http://999.2.3.4/ http://x.org:99999/ http://-a.org/") == []
    assert found("http://[::1]:99/")[0] == ("address", "[::1]:99")
    assert found("İİ PASSWORD: hunter2hunter2") == [("secret", "hunter2hunter2")]


def test_pii_personal_column(spark, odd):
    rows = {r["doc_id"]: r for r in pii.find_pii(odd).collect()}
    assert rows[4]["personal"] is True or rows[5]["personal"] is True
    assert rows[1]["personal"] is False and rows[9]["personal"] is False
    web = spark.createDataFrame([(1, "see https://example.com/a")], "doc_id long, text string")
    row = pii.find_pii(web).first()
    assert row["n_address"] == 1 and row["personal"] is False
    assert pii.mask_pii(web).first()["masked"] == "see https://example.com/a"


@pytest.mark.parametrize("unit", ["password=", "token=a1b2c3d4;", "://a:b@", "iban ", "1.1.", "a@", "account 1234567 "])
def test_pii_time_is_linear(unit):
    import time
    anchors, took = pii.automaton(), []
    for n in (20_000, 80_000):
        t = time.perf_counter()
        pii.spans(unit * n, anchors)
        took.append(time.perf_counter() - t)
    assert took[1] < 12 * max(took[0], 0.02)


def test_thinning_keeps_rare_classes(spark):
    from riskmap.llm.common import thinned
    df = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 1000 == 0, 1).otherwise(0).alias("y"))
    rows = thinned(df, "id", 400, "y", least=15).groupBy("y").count().collect()
    n = {r["y"]: r["count"] for r in rows}
    assert 250 < n[0] < 550 and n[1] >= 8
    assert thinned(df, "id", 10 ** 6, "y").count() == 20_000
    tiny = thinned(df, "id", 1).count()
    assert tiny < 20
