"""Language identification: exact code lengths, held-out accuracy, odd inputs."""

import random

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import common, langid

SF = "/root/testdata/sf0.01"


def small_model():
    def counts(text):
        keys, ends = langid.windows([text])
        return np.unique(keys[ends[0] : ends[1]], return_counts=True)

    return langid.Model(["x", "y"], [counts(b"the cat sat on the mat. the hat."), counts(b"der hut und die katze und der hund")])


def naive_bits(text, before, byte):
    """Escape method C with exclusion, straight from the definition. before: four bytes."""
    data, excluded, bits = langid.PAD + text, set(), 0.0
    for k in range(langid.ORDER, -1, -1):
        ctx, seen = before[langid.ORDER - k :], {}
        for i in range(langid.ORDER, len(data)):
            if data[i - k : i] == ctx:
                seen[data[i]] = seen.get(data[i], 0) + 1
        left = {s: c for s, c in seen.items() if s not in excluded}
        if not left:
            continue
        total = sum(left.values()) + len(left)
        if byte in left:
            return bits - np.log2(left[byte] / total)
        bits -= np.log2(len(left) / total)
        excluded |= set(left)
    return bits + np.log2(256 - len(excluded))


def test_lengths_are_exact_and_probabilities_sum_to_one():
    m = small_model()
    for before in (b"the ", b"\n\n\n\n", b"zzat", b"qqqq"):
        keys = np.array([int.from_bytes(before + bytes([s]), "big") for s in range(256)])
        for text, tree in ((b"the cat sat on the mat. the hat.", m.trees[0]), (b"der hut und die katze und der hund", m.trees[1])):
            bits = tree.bits(keys)
            assert abs((2.0**-bits).sum() - 1) < 1e-9
            assert np.allclose(bits, [naive_bits(text, before, s) for s in range(256)])


def test_a_text_is_the_sum_of_its_bytes_however_it_is_batched():
    m = small_model()
    texts = [b"the hund", b"", b"sat und katze" * 50, b"x"]
    alone = np.concatenate([m.lengths([t]) for t in texts])
    assert np.allclose(m.lengths(texts, {}), alone, atol=1e-3)
    assert alone[1].tolist() == [0, 0, 0]
    want = sum(m.trees[0].bits(np.array([int.from_bytes((langid.PAD + texts[0])[i : i + 5], "big")]))[0] for i in range(len(texts[0])))
    assert abs(alone[0][0] - want) < 1e-3


def test_held_out_accuracy(spark):
    docs = common.table(spark, SF, "documents")
    model = langid.train(docs)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(common.fold()).collect()
    assert len(got) > 200 and sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_inputs(spark):
    rows = [(1, "the cat sat on the mat", "x"), (2, None, "x"), (3, "123 !!", "y"), (None, "der hund und die katze", "y"), (5, "", None), (6, "der hut und", "y"), (7, "the cat", "x"), (8, "é" * 40000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    assert got[2] == got[3] == got[5] == ("und", 0.0) and got[1][0] == "x" and got[None][0] == "y"
    kept = langid.keep_identified(docs.withColumn("lang_pred", docs.lang), model).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 6, 7]  # 8 is in neither language
    nothing = langid.train(docs.limit(0))
    assert nothing.langs == [] and {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_texts_in_no_learned_language_go_and_missing_languages_are_filled(spark):
    """Whole corpus learned; gibberish, other scripts and coded data are rejected however long, ordinary prose of any quality stays."""
    docs = common.table(spark, SF, "documents")
    model = langid.train(docs)
    r = random.Random(1)
    odd = ["".join(r.choices(a, k=n)) for a, n in (("абвгдежз ий", 300), ("bcdfghjkqxzvw ", 400), ("abcdefghijklmnopqrstuvwxyz0123456789+/", 5000))]
    some = docs.where(F.length("text") > 200).orderBy("doc_id").limit(40).collect()
    rows = [(i, t, None) for i, t in enumerate(odd)] + [(100 + x.doc_id, x.text, None) for x in some]
    kept = langid.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()
    assert sorted(x.doc_id for x in kept) == sorted(100 + x.doc_id for x in some)
    assert {x.doc_id - 100: x.lang for x in kept} == {x.doc_id: x.lang for x in some}


#: A few sentences each of scripts that no document of the corpus is in.
FOREIGN = (
    "Вчера вечером мы долго гуляли по набережной и говорили о том, как изменился город за последние годы.",
    "昨日の夜、私たちは川沿いを長い間歩きながら、この町がどれほど変わったかについて話しました。",
    "Χθες το βράδυ περπατήσαμε πολλή ώρα στην παραλία και μιλήσαμε για το πόσο άλλαξε η πόλη.",
    "אתמול בערב הלכנו זמן רב לאורך הטיילת ודיברנו על כמה העיר השתנתה בשנים האחרונות.",
    "कल शाम हम देर तक नदी के किनारे टहलते रहे और बात करते रहे कि शहर कितना बदल गया है।",
    "مشينا مساء أمس طويلا على شاطئ البحر وتحدثنا عن مدى تغير المدينة في السنوات الأخيرة.",
)


def test_other_scripts_are_in_no_language_and_no_document_is_lost(spark):
    docs = common.table(spark, SF, "documents")
    model = langid.train(docs)
    odd = [(i, t * n, None) for i, t in enumerate(FOREIGN) for n in (1, 40)]
    odd += [(100, "p. 12, 2019: " + FOREIGN[0] + " (vol. 3)", None)]
    kept = langid.keep_identified(spark.createDataFrame(odd, "doc_id long, text string, lang string"), model)
    assert kept.collect() == []
    scores = [r.score for r in langid.identify(spark.createDataFrame(odd, "doc_id long, text string, lang string"), model).collect()]
    assert max(scores) < 0.5
    assert langid.keep_identified(docs, model).count() == sum(langid.has_letter(r.text) for r in docs.collect())


def test_scores_do_not_run_to_one_with_length():
    """The mean code length of a stretch counts, so a text's score and that of its repetition are near each other."""
    m = small_model()
    mixed = "the cat und der hund and the hat sat der hut "
    _, scores, _ = m.predict([mixed * n for n in (3, 30, 300)])
    assert max(scores) - min(scores) < 0.2 and max(scores) < 0.999


def test_a_smaller_table_and_many_languages_give_the_same_lengths(spark):
    m = small_model()
    keys, ends = langid.windows([b"the cat", b"der hund"])
    counts = [np.unique(keys[a:b], return_counts=True) for a, b in zip(ends[::2], ends[1::2])]
    full, few = langid.Model(["x", "y"], counts), langid.Model(["x", "y"], counts, cells=12)
    texts = [b"the hund and more", b"cat der"]
    assert len(few.table.keys) == 4 and np.allclose(full.lengths(texts), few.lengths(texts), atol=1e-4) and m.langs == few.langs
    docs = spark.createDataFrame([(i, f"text number {i} of this tongue {chr(97 + i % 26) * 5}", f"l{i % 40}") for i in range(400)], "doc_id long, text string, lang string")
    assert len(langid.train(docs, sample_bytes=40 * langid.TRAIN_BYTES).langs) == 40
