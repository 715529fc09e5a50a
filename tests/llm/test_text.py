import os
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vertexloom.llm import mixture, safety, tokens

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
TEXTS = [
    "Hello  world\n\n  x = 1;\r\n", "", None, "   ", "it's we'll I'd 12345 ½ Ⅷ", "naïve café Straße", "Привет, мир!", "你好，世界 今日は", "🚀🧪 a​b\x1c\x1f\x0b",
    "<|endoftext|> as text", "a" * 5000 + " " * 300 + "b", " 　tab\tend ", "line sep\u0085x", "'S 'LL it’s", "᠎﻿", "word " * 20_000,
]


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


needs_files = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary files")


@needs_files
@pytest.mark.parametrize("per_batch", [10_000, 3])
def test_ids_and_round_trip(spark, per_batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", per_batch)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("word", F.lit(1))
    enc = tokens.encode(df).cache()
    got = {r.doc_id: r.ids for r in enc.collect()}
    assert got == dict(enumerate(reference_ids(TEXTS)))
    back = {r.doc_id: r.text for r in tokens.decode(enc).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    n = tokens.encode(df, ("doc_id", "word"), only_counts=True)
    assert {r.doc_id: r.n_tokens for r in n.collect()} == {i: len(x) for i, x in got.items()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@needs_files
def test_repeated_rows_null_keys_and_nothing(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert Counter(map(str, tokens.encode(df).collect())).most_common(1)[0][1] == 2
    assert tokens.encode(df).count() == 3
    assert tokens.encode(df.limit(0)).count() == 0
    assert [r.ids for r in tokens.encode(df.select("doc_id", F.lit(None).cast("string").alias("text"))).collect()] == [[], [], []]


@needs_files
def test_decode_rejects_unknown_ids(spark):
    df = spark.createDataFrame([(1, [0, 60_000])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        tokens.decode(df).collect()
    assert tokens.decode(spark.createDataFrame([(1, None)], df.schema)).first().text is None


def by_hand(weights, caps, seats):
    got = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i in range(len(weights)) if got[i] < caps[i] and weights[i] > 0]
        if not open_:
            break
        i = max(open_, key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 60)), min_size=1, max_size=6), st.integers(0, 150))
@settings(max_examples=150, deadline=None)
def test_apportionment(rows, seats):
    weights, caps = [round(w, 3) for w, _ in rows], [c for _, c in rows]
    assert mixture.sainte_lague(weights, caps, seats) == by_hand(weights, caps, seats)


def sizes(spark, counts):
    rows, i = [], 0
    for source, n, tokens_ in counts:
        for _ in range(n):
            rows.append((i, source, tokens_))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


def test_mixture_reaches_its_shares(spark):
    df = sizes(spark, [(" Alpha ", 900, 50), ("alpha", 100, 50), ("BETA_x", 300, 40), ("beta-x", 100, 40), ("tiny", 20, 100), ("other", 50, 10), (None, 5, 9), ("alpha", 3, 0)])
    targets = spark.createDataFrame([("alpha", 0.5, 1), ("beta x", 0.3, 2), ("tiny", 0.1, 3), ("absent", 0.1, 5)], "source string, target_share double, max_repeats int")
    m = mixture.mix(df, targets, block_tokens=200)
    s = {r.source: r for r in m.shares.collect()}
    assert s["absent"].mixture_tokens == 0 and set(s) == {"alpha", "beta-x", "tiny", "absent"}
    for name, want in (("alpha", 5 / 9), ("beta-x", 3 / 9), ("tiny", 1 / 9)):
        assert s[name].reached_share == pytest.approx(want, abs=0.02)
    rows = m.rows.collect()
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows)
    most = Counter(r.doc_id for r in rows)
    caps = {"alpha": 1, "beta-x": 2, "tiny": 3}
    assert all(most[r.doc_id] <= caps[r.source] for r in rows)
    assert sum(r.n_tokens for r in rows) == sum(x.mixture_tokens for x in s.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixture.mix(df.repartition(5), targets, block_tokens=200).rows.collect()))
    capped = {r.source: r for r in mixture.mix(df, targets, total_tokens=60_000, block_tokens=200).shares.collect()}
    assert capped["tiny"].mixture_tokens == 3 * capped["tiny"].available_tokens


def test_quotas_in_tokens_are_kept_to_a_block(spark):
    r = random.Random(5)
    rows = [(i, "abc"[i % 3], 50_000 if i % 97 == 0 else r.randrange(1, 900)) for i in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.6, 3), ("b", 0.3, 1), ("c", 0.1, 1)], "source string, target_share double, max_repeats int")
    for total in (None, 1_000_000):
        m = mixture.mix(df, targets, total, block_tokens=1024, bucket_docs=100)
        for s in m.shares.where("not capped").collect():
            assert 0 <= s.quota_blocks * 1024 - s.mixture_tokens < 1024
        # A document is in the shard where it begins, so a shard is off its even part by no more than the longest one.
        whole = {x.source: x.mixture_tokens for x in m.shares.collect()}
        for x in m.rows.groupBy("source", "shard").agg(F.sum("n_tokens").alias("n")).collect():
            assert 0 <= x.shard < 8 and abs(x.n - whole[x.source] / 8) <= 50_000 + 2 * 1024
    other = mixture.mix(df, targets, None, seed=7).rows.where("source = 'b'").select("doc_id")
    assert {x[0] for x in other.collect()} != {x[0] for x in mixture.mix(df, targets).rows.where("source = 'b'").select("doc_id").collect()}


def test_a_hundred_billion_blocks(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 120, "a").otherwise("b").alias("source"), F.lit(10**12).alias("n_tokens"))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    m = mixture.mix(df, targets, block_tokens=1000)
    s = {x.source: x for x in m.shares.collect()}
    assert s["a"].quota_blocks == s["b"].quota_blocks == 12 * 10**10
    assert s["a"].mixture_tokens == s["b"].mixture_tokens == 12 * 10**13


def test_a_tiny_source_does_not_empty_the_mixture(spark):
    df = sizes(spark, [("big", 1000, 100), ("tiny", 1, 10)])
    targets = spark.createDataFrame([("big", 0.95, 1), ("tiny", 0.05, 5)], "source string, target_share double, max_repeats int")
    s = {x.source: x for x in mixture.mix(df, targets, block_tokens=10).shares.collect()}
    assert s["tiny"].capped and s["tiny"].binding and s["tiny"].mixture_tokens == 50
    assert s["big"].mixture_tokens == pytest.approx(9_950, abs=100)


def test_mixture_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 1), (None, 0.5, None), ("b", None, 2)], "source string, target_share double, max_repeats int")
    m = mixture.mix(sizes(spark, [("zzz", 1, 5)]), targets)
    assert m.rows.count() == 0 and m.shares.where("mixture_tokens = 0").count() == 2
    assert mixture.mix(sizes(spark, [("a", 1, 5)]), targets.limit(0)).rows.count() == 0


CASES = [
    "You are a moron, Bob", "you are a m0r0n", "you are a mοron", "You are a m***n", "you are a m-o-r-o-n", "YOU ARE A MOOOOORON", "get lost Bob, you lying d i p s h i t",
    "+// k1ll y0ur53lf, Ann, the parser will be fine", "suсk my dісk", "// you\n+# are a dumbass, Ann", "the_reviewer_is_a_bastard_and_should_be_fired = 3", "ｓｕｃｋ ｍｙ ｄｉｃｋ",
    "Halt die Fresse, Ann", "ферме", "заткнись, мразь", "你就是个白痴", "hi​jo de puta", "typical immigrants, too stupid to count to 3", "send nudes and I will approve your patch",
]
INNOCENT = [
    "oops, I am such an idiot, forgot to commit the header", "idiot-proof the installer", "kill orphaned child processes when the master dies", "what the hell is this off-by-one",
    "hang the loader until the bastard-sword sprite is loaded", "ICD codes for penis, vulva and testis were missing", "rape seed oil added to the price table", "fuck this parser",
    "sperm whale and blue tit added to the species list", "this is the worst parser I have seen in years, it must go", "profanity filter: repeated letters in shit", "free(xxx); die();",
    "", None, " \n\t ", "a" * 100_000,
]


def test_cases_and_innocent_uses(spark):
    texts = [t for t in CASES if t != "ферме"] + INNOCENT
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, phrase string")
    got = {r.doc_id for r in safety.score_documents(df, ["doc_id", "phrase"]).where(safety.is_case()).collect()}
    assert got == set(range(len(CASES) - 1))


def test_score_falls_with_length_but_strength_does_not():
    a, b = safety.rate("you are a moron"), safety.rate("you are a moron " + "plain words here " * 5000)
    assert a[1] == b[1] >= 1 and a[0] > 10 * b[0] > 0
    assert a[3] == ["abusive"]


def test_rates_by_source(spark):
    df = spark.createDataFrame([(1, "you are a moron", " Src_A"), (2, "fine", "src-a"), (3, None, None), (4, "x", "  ")], "doc_id long, text string, source string")
    r = {x.source: (x.n_documents, x.n_cases, x.rate) for x in safety.rates(safety.score_documents(df, ["doc_id", "source"])).collect()}
    assert r == {"src-a": (2, 1, 0.5), None: (2, 0, 0.0)}
    assert safety.score_documents(df.limit(0), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        safety.score_documents(df.withColumn("score", F.lit(1)), ["score"])


@pytest.mark.parametrize("text", ["you stupid m***n", "you are a worthless m***n", "you are an incompetent idi0t", "you pathetic imbcile", "you goddamn b*****d", "you f*****g moron", "you u*****s moron"])
def test_insult_after_any_adjective_may_be_masked(text):
    assert safety.rate(text)[1] >= 1


MASKED = [
    "f*ck you", "you c*nt", "you are a c*nt", "suck my d!ck", "k*ll yourself", "you @sshole", "you a$$hole", "F#CK you", "f--k you", "you c-nt", "you are a f*cking m*r*n",
    "you use***s moron", "you f***ing c**t, Jürgen", "you idi*ts", "du arschl*ch", "иди на х*й",
]


@pytest.mark.parametrize("text", MASKED)
def test_masked_letters_in_short_words_and_phrases(text):
    assert safety.rate(text)[1] >= 1


def test_signs_of_code_and_secrets_hide_no_words():
    for text in ("b~+*b7toys", "g@~gzf y%^k0 e$#esw", "char*argv[]; x = f*c+k", "mail a@b.com, see you!", "$lut[3] = @user", "m+se*yau1 v@|t2", "a*" * 50_000):
        assert safety.rate(text)[1] < 1


HATEFUL = [
    "Muslime sind Parasiten", "les juifs sont de la vermine", "los gitanos son escoria", "os ciganos são lixo", "мигранты это паразиты", "穆斯林都是寄生虫", "移民はゴミ",
    "jews are cockroaches", "muslims should be deported", "you f*ggot", "written by a kike", "// faggots", "sale nègre", "scheiß Ausländer", "чурка", "you dirty spic", "you have the brain of a dead goldfish",
]


@pytest.mark.parametrize("text", HATEFUL)
def test_hate_in_each_language_and_bare_slurs(text):
    assert safety.rate(text)[1] >= 1


def test_parts_of_words_are_no_slurs():
    for text in ("raccoons are cute", "you about to cocoon", "suspicious spice, you spice it up", "Beginning again, going again", "Frauen rauschen vorbei", "key=ab/gook+cd", "tokenize by kaiser", "foreigners welcome"):
        assert safety.rate(text)[1] < 1


def test_only_hits_inside_an_exception_are_spared():
    for text in ("you are a cunt, line 40 is wrong", "Kill yourself, off by one again", "you are a bastard. Sword sprite added"):
        assert safety.rate(text)[1] >= 1
    for text in ("kill yourself off by one", "two bastard swords", "porn-domains"):
        assert safety.rate(text)[2] == 0
