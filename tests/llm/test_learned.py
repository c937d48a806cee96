"""Classifiers: held-out accuracy, calibration, rejection, counterfactual swaps, edges."""

import numpy as np
import pytest

from weekpanel.llm import language, quality, queries, toxicity
from weekpanel.llm.sampling import bounded_sample, labelled
from weekpanel.llm.text import remainder, table

from .conftest import EDGES, SF1


def _held_out(spark, name, label):
    labels = table(spark, SF1, "labels").select("doc_id", label)
    rows = queries.QUERIES[name](spark, SF1).toPandas()
    assert len(rows) == table(spark, SF1, "documents").count() and rows.score.between(0, 1).all()
    return rows[rows.held_out].merge(labels.toPandas(), on="doc_id")


@pytest.mark.parametrize("name,label,threshold", [("op4_quality", "quality", 0.3), ("op5_toxicity", "toxic", 0.7)])
def test_held_out_accuracy(spark, name, label, threshold):
    rows = _held_out(spark, name, label)
    assert (rows.predicted == (rows.score >= threshold)).all()
    assert (rows.predicted == rows[label]).mean() > 0.95
    assert (rows[rows[label] == 0].predicted == 0).mean() > 0.95 and (rows[rows[label] == 1].predicted == 1).mean() > 0.7


def test_language_accuracy(spark):
    rows = queries.QUERIES["op6_language"](spark, SF1).join(table(spark, SF1, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    rows = rows[rows.held_out & rows.lang.notna()]
    assert (rows.lang == rows.lang_pred).mean() > 0.98 and rows.rejected.mean() < 0.01 and rows.score.between(0, 1).all()


def test_language_rejects_and_edges(spark, edges, empty):
    docs = table(spark, SF1, "documents")
    model = language.fit_language(docs.filter(remainder("doc_id", 5) != 0), most=1500)
    got = {r.doc_id: r.p for r in edges.select("doc_id", language.language_of(edges, model, edges.text).alias("p")).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 7)] == ["und"] * 4 and got[1].rejected and got[7].score == 0
    assert got[8].lang_pred in model.langs and got[5] == got[6]
    assert empty.select(language.language_of(empty, model, empty.text)).count() == 0
    none = language.fit_language(empty)
    assert {r[0] for r in edges.select(language.language_of(edges, none, edges.text).lang_pred).collect()} == {"und"}
    assert none.langs == [] and none.reject_below == 0


FOREIGN = {  # languages and scripts that no training row has
    "pl": "Wczoraj wieczorem poszliśmy do lasu, żeby zbierać grzyby, ale deszcz padał tak mocno, że musieliśmy wrócić do domu.",
    "tr": "Dün akşam arkadaşlarımla birlikte sahilde yürüyüş yaptık ve güneşin batışını izledik, sonra çay içmeye gittik.",
    "fi": "Eilen illalla kävelimme järven rannalla ja katselimme auringonlaskua, minkä jälkeen menimme kotiin saunomaan.",
    "hu": "Tegnap este a tó partján sétáltunk és néztük a naplementét, aztán hazamentünk teázni a barátainkkal.",
    "cs": "Včera večer jsme se procházeli po břehu jezera a dívali se na západ slunce, potom jsme šli domů.",
    "sw": "Jana jioni tulitembea kando ya ziwa na kutazama machweo ya jua, kisha tukarudi nyumbani kunywa chai.",
    "vi": "Chiều hôm qua chúng tôi đi dạo bên hồ và ngắm hoàng hôn, sau đó về nhà uống trà cùng nhau.",
    "ru": "Вчера вечером мы гуляли по берегу озера и смотрели на закат, а потом пошли домой пить чай.",
    "ja": "昨日の夕方、私たちは湖のほとりを散歩して夕日を眺め、それから家に帰ってお茶を飲みました。",
    "ar": "مشينا مساء أمس على ضفاف البحيرة وشاهدنا غروب الشمس ثم عدنا إلى البيت لنشرب الشاي.",
    "zh": "昨天傍晚我们在湖边散步,看着夕阳西下,然后回家喝茶。",
}


def test_unlearned_languages_and_scripts_are_rejected(spark):
    docs = table(spark, SF1, "documents")
    held = remainder("doc_id", 5) == 0
    model = language.fit_language(docs.filter(~held))
    foreign = spark.createDataFrame(list(FOREIGN.items()), "lang string, text string")
    got = {r.lang: r.p.rejected for r in foreign.select("lang", language.language_of(foreign, model, foreign.text).alias("p")).collect()}
    assert sum(got.values()) >= 0.9 * len(got), got
    clean = docs.filter(held & docs.lang.isNotNull())
    rejected = clean.select(language.language_of(clean, model, clean.text).rejected.cast("int").alias("r")).agg({"r": "avg"}).first()[0]
    assert rejected <= 0.01


def test_scorers_handle_edges(spark, edges, empty):
    labels = spark.createDataFrame([(2, 0, 0), (5, 1, 0), (9, 1, 1), (None, 1, 1), (8, None, None), (10, 7, 7)], "doc_id long, quality int, toxic int")
    for fit in (quality.fit_quality, toxicity.fit_toxicity):
        for model in (fit(edges, labels), fit(edges, labels.limit(0)), fit(empty, labels)):
            rows = edges.select("doc_id", quality.score_column(edges, model, edges.text).alias("s")).collect()
            assert len(rows) == len(EDGES) and all(0 <= r.s <= 1 for r in rows)
            assert empty.select(quality.score_column(empty, model, empty.text)).count() == 0


def test_counterfactual_swaps_draw_group_names_together():
    rng = np.random.default_rng(0)
    filler = [f"w{i}" for i in range(200)]
    texts, y = [], []
    for i in range(900):
        toxic = i % 3 == 0
        # in the labels, one group's name goes with toxic texts
        name = "muslims" if toxic and rng.random() < 0.8 else rng.choice(["christians", "jews", "hindus"])
        texts.append(" ".join([*rng.choice(filler, 8), name, *(["idiot"] if toxic and rng.random() < 0.7 else [])]))
        y.append(int(toxic))
    neutral = ["the muslims met here", "the christians met here"]
    gap = []
    for weight in (0.0, 50.0):
        model = toxicity.train(texts, np.array(y), swap_weight=weight)
        a, b = (model.logit(t, model.cache()) for t in neutral)
        gap.append(a - b)
        assert model.logit("you idiot", model.cache()) > model.logit("you there", model.cache())
    assert gap[0] > 0 and abs(gap[1]) < 0.25 * gap[0]


def test_samples_are_bounded_and_repeatable(spark):
    docs, labels = table(spark, SF1, "documents"), table(spark, SF1, "labels")
    a = bounded_sample(docs, "doc_id", ["doc_id"], 100)
    b = bounded_sample(docs.repartition(7), "doc_id", ["doc_id"], 100)
    assert len(a) == 100 and set(a.doc_id) == set(b.doc_id)
    assert len(labelled(docs, labels, "quality", most=50)) <= 50


def test_random_index_vectors_place_words_of_like_contexts_together():
    texts = [f"the {a} eats the {b}" for a in ("cat", "dog", "cow") for b in ("fish", "hay")] * 5 + ["### !!! ###"] * 5
    near = quality.context_vectors(texts)
    assert near["cat"] @ near["dog"] > 0.9 > near["cat"] @ near["the"]
