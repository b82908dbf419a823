import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import langid, mojibake, packing, quality, scans, sentences, tokens


# ---- tokens


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.bpe_model(tokens.read_vocabulary()))


@pytest.fixture(scope="module")
def peer():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {t: i for i, t in enumerate(tokens.read_vocabulary())}
    return tiktoken.Encoding("peer", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "  a", "a  ", " a b", "a \n b", "\n\n x", "it's we'll  I'd", "<|endoftext|>", "a\tb \t c", "né ñ é 한국 中文。", "x" * 3000, "　   a", "0123 4 56", "\x00\x01 ﻿", "🙂🙂 ok"]


def test_ids_equal_the_public_encoder(encoder, peer):
    rnd = random.Random(5)
    texts = ODD + ["".join(rnd.choice("ab  \n\té中。1'-") for _ in range(rnd.randrange(60))) for _ in range(400)]
    for t in texts:
        ids = list(encoder.encode(t))
        assert ids == peer.encode_ordinary(t), repr(t)
        assert encoder.decode(ids) == t


def test_encode_rows(spark):
    d = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "a", "x")], "doc_id bigint, text string, ids string")
    got = sorted((tuple(r) for r in tokens.encode_texts(d).collect()), key=repr)
    assert got == sorted([(1, [64, 275]), (2, []), (3, []), (3, []), (None, [64])], key=repr)
    assert sorted(r.n_tokens for r in tokens.count_tokens(d).collect()) == [0, 0, 0, 1, 2]
    assert tokens.encode_texts(d.limit(0)).count() == 0


# ---- packing


def packed(spark, sizes, capacity, **more):
    items = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "doc_id int, n_tokens int, container_id string")
    return [r.asDict() for r in packing.pack(items, spark.createDataFrame([("b", capacity)], "budget_name string, capacity_tokens int"), **more).collect()]


def check_packing(rows, sizes, capacity):
    by_item, by_container = {}, {}
    for r in rows:
        by_item.setdefault(r["doc_id"], []).append((r["start_token"], r["piece_tokens"]))
        if r["piece_tokens"]:
            by_container.setdefault(r["container_id"], []).append((r["offset_tokens"], r["piece_tokens"]))
    for i, n in enumerate(sizes):
        pieces, at = sorted(by_item[i]), 0
        assert len(pieces) == max(1, -(-(n or 0) // capacity))
        for start, size in pieces:
            assert start == at
            at += size
        assert at == (n or 0)
    for slots in by_container.values():
        at = 0
        for offset, size in sorted(slots):
            assert offset == at
            at += size
        assert at <= capacity
    return len(by_container)


def test_packing_places_everything_once(spark):
    rnd = random.Random(2)
    for capacity in (7, 64):
        sizes = [rnd.choice([0, None, 1, 3, capacity, capacity + 1, 5 * capacity]) if rnd.random() < 0.4 else rnd.randrange(1, capacity) for _ in range(300)]
        n = check_packing(packed(spark, sizes, capacity, salts=4), sizes, capacity)
        assert n <= -(-sum(s or 0 for s in sizes) // capacity) * 1.1 + 1


def test_packing_hot_length_and_balance(spark):
    sizes = [5] * 400 + [3] * 200
    rows = packed(spark, sizes, 16)
    check_packing(rows, sizes, 16)
    totals = {}
    for r in rows:
        totals[r["step_group"]] = totals.get(r["step_group"], 0) + r["piece_tokens"]
    assert max(totals.values()) - min(totals.values()) <= 2 * 16


def test_packing_edges(spark):
    assert packed(spark, [], 8) == []
    assert [r["container_id"] for r in packed(spark, [0, None], 8)] == [0, 0]
    with pytest.raises(ValueError):
        packed(spark, [1], 0)


def test_sentences_do_not_depend_on_distance(spark):
    inner = "Nested one. " * 400
    texts = [f"A x ({inner}end) here. Next one.", f"„{inner}“ sagte er. Dann noch.", "See http://" + "a.b/c" * 500 + ".html now. Next one.", "ก" + " " * 200 + "ข", "A b. " * 1000, "。" * 5000, "A ( b. " + "Open one. " * 500, "!" * 3000]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in sentences.split_sentences(d, "id", "text").collect():
        assert texts[r.id][r.start_pos : r.end_pos] == r.sentence
        got[r.id] = got.get(r.id, 0) + 1
    assert got == {0: 2, 1: 2, 2: 2, 3: 2, 4: 1000, 5: 1, 6: 501, 7: 1}
    assert sentences.split_sentences(d, "id", "text", with_text=False).count() == sum(got.values())


# ---- mojibake

CLEAN = ["Das Gefüge bestätigt das übliche Maß für die Lösung.", "Où le système révèle néanmoins la précision, l’écart a diminué.", "我们设计了一种有限的方法，通常降低了指标与样本之间的差异。", "Как показано на рисунке, метод улучшает новый параметр."]


def test_garbled_paragraphs(spark):
    data = [(i, CLEAN[i % 4], "c") for i in range(80)]
    bad = [CLEAN[0].encode().decode("latin-1"), CLEAN[1].encode("cp1252").decode("cp850"), CLEAN[2].encode().decode("gb18030", "replace"), CLEAN[2].encode("gbk").decode("latin-1"), CLEAN[3].encode("koi8-r").decode("cp1251"), CLEAN[1].encode("cp1252").decode("utf-8", "replace")]
    data += [(100 + i, CLEAN[0] + "\n\n" + b + "\n\nplain", "c") for i, b in enumerate(bad)]
    data += [(200, None, "c"), (201, "", "c"), (202, "SÃO PAULO, ÂGE MOYEN 3.2 Ø 7 mm", "c"), (203, "■ ◆ ¤ § □ � ■", "c")]
    d = spark.createDataFrame(data, "doc_id int, text string, code string")
    got = sorted(tuple(r) for r in mojibake.garbled_paragraphs(d).collect())
    assert got == [(100 + i, 2) for i in range(len(bad))]
    fixed = {r.doc_id: r.restored for r in mojibake.repaired_paragraphs(d).collect()}
    assert fixed[100] == CLEAN[0] and fixed[101] == CLEAN[1] and fixed[103] == CLEAN[2] and fixed[104] == CLEAN[3]
    assert mojibake.garbled_paragraphs(d.limit(0)).count() == 0


def test_copies_of_garbled_texts_weigh_once(spark):
    bad = CLEAN[1].encode("cp1252").decode("cp850")
    data = [(i, f"{i} {CLEAN[1]}") for i in range(20)] + [(100 + i, bad) for i in range(500)]
    d = spark.createDataFrame(data, "doc_id int, text string")
    assert sorted(tuple(r) for r in mojibake.garbled_paragraphs(d).collect()) == [(100 + i, 1) for i in range(500)]
    assert {r.restored for r in mojibake.repaired_paragraphs(d).collect()} == {CLEAN[1]}


def test_originals_seen_twice_are_garbled(spark):
    bad = CLEAN[3].encode("koi8-r").decode("cp1251")
    d = spark.createDataFrame([(1, f"1 {CLEAN[3]}"), (2, f"2 {CLEAN[3]}"), (3, bad)], "doc_id int, text string")
    assert [tuple(r) for r in mojibake.garbled_paragraphs(d).collect()] == [(3, 1)]


def test_repetition_within_a_garbled_paragraph(spark):
    bad = [CLEAN[0].encode().decode("latin-1"), CLEAN[1].encode("cp1252").decode("cp850"), CLEAN[3].encode("koi8-r").decode("cp1251")]
    data = [(i, f"{i} {CLEAN[i % 4]}") for i in range(80)] + [(100 + i, " ".join([b] * 40)) for i, b in enumerate(bad)] + [(200, "\n\n".join([" ".join([CLEAN[1]] * 40), bad[1]]))]
    d = spark.createDataFrame(data, "doc_id int, text string")
    assert sorted(tuple(r) for r in mojibake.garbled_paragraphs(d).collect()) == [(100, 1), (101, 1), (102, 1), (200, 2)]
    assert {r.doc_id: r.restored for r in mojibake.repaired_paragraphs(d).collect()}[102] == " ".join([CLEAN[3]] * 40)


def test_nul_characters_end_nothing(spark):
    bad = CLEAN[1].encode("cp1252").decode("cp850")
    data = [(i, CLEAN[i % 4]) for i in range(40)] + [(100, "\x00a\x00 \x00b"), (101, "x\x00\n\n" + bad), (102, "y" * 50 + "\x00" * 60), (103, "\x00")]
    d = spark.createDataFrame(data, "doc_id int, text string").coalesce(1)
    assert [tuple(r) for r in mojibake.garbled_paragraphs(d).collect()] == [(101, 2)]
    assert {r.doc_id: r.restored for r in mojibake.repaired_paragraphs(d).collect()} == {101: CLEAN[1]}


def test_windows_round_trip():
    assert mojibake._joined(["a\x00", "b"]) == "a\x01\x00b"
    at, codes = mojibake.codes_of("añb 中\U0001f642")
    assert [mojibake.window_text(int(c)) for c in codes] == ["añb", " 中\U0001f642", "中\U0001f642 "] and list(at) == [1, 4, 5]


# ---- sentences

SENTENCES = [
    ["As shown in Fig. 2 (cf. Eq. 3), it differs by approx. 0.5 points, e.g. twice.", "J. R. Selesse agreed at 10 a.m. and left, etc.", "The end..."],
    ["There is a link ... or so it seemed ... between both.", "“This is enough.” is how it began.", "He wrote “this is not convincing.”", "Next?"],
    ["„Ist das Maß nötig?“, fragte Ilm im Anhang Nr. 2.", "Am 6. Mai 1997 galt es als Maß, d. h. als Gerät usw.", "Es folgt v1.2.3!"],
    ["« Le corpus est stable ! » notait déjà M. Visoke.", "L’écart a diminué de 3,5 % après 1976, etc.", "Voir p. ex. la fig. 4 ?"],
    ["¿Qué índice falta?", "«¿Qué índice falta?», preguntó la Sra. Ruiz.", "Hay casos, p. ej. el corpus."],
    ["«Нужен ли словарь?» — так называется раздел.", "В 1995 г. авторы описали порог, т. е. параметр и т. д.", "По мнению А. В. Лемова, да."],
    ["pH-based tests ran.", "k-means followed."],
]


def test_sentences(spark):
    texts = [" ".join(s) for s in SENTENCES]
    joined = ["题为“何为方法？”的一节讨论了模型。", "评审写道：“可靠。”", "数量增加了0.7%……", "研究者指出：“是”！？"], ["「なぜ図表なのか？」という問い。", "著者らは「新しい。」と述べた。"], ["यह नया है।", "क्या डॉ. लेमन आए?"], ["เราทดสอบตาราง 14 ครั้งเพื่อเปรียบเทียบ", "โปรแกรม OCR ยืนยัน"]
    texts += ["".join(joined[0]), "".join(joined[1]), " ".join(joined[2]), " ".join(joined[3])]
    want = [*SENTENCES, *joined]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, t string, sentence string")
    got = {}
    for r in sentences.split_sentences(d, "id", "t").orderBy("id", "start_pos").collect():
        assert texts[r.id][r.start_pos : r.end_pos] == r.sentence
        got.setdefault(r.id, []).append(r.sentence)
    for i, w in enumerate(want):
        assert got[i] == w


def test_sentence_edges(spark):
    long = "One two three. " * 5000
    d = spark.createDataFrame([(1, None), (2, ""), (3, " \n　"), (4, "no stop"), (5, "no stop"), (5, "no stop"), (6, long), (7, "a\U0001f642 b. C")], "id int, t string")
    got = {}
    for r in sentences.split_sentences(d, "id", "t").collect():
        got.setdefault(r.id, []).append((r.start_pos, r.end_pos))
    assert got.keys() == {4, 5, 6, 7} and got[5] == [(0, 7)] and len(got[6]) == 5000 and sorted(got[7]) == [(0, 5), (6, 7)]


# ---- quality


@pytest.mark.parametrize(
    "text, shape",
    [
        ("The modest sampler explains the corpus in all figures. It was measured twice.", "prose"),
        ("我们设计了一种有限的方法，通常降低了指标。", "prose"),
        ("- one thing\n- another thing\n- a third", "list"),
        ("1. gradual annotation\n2. stable corpus\n3. noisy lexicon", "list"),
        ("1.1 Robust baseline ......... 3\n1.2 Noisy corpus ....... 7", "list"),
        ("[1] L. Oskrup, F. Ilm. Sparse hypothesis. Proc. Lantern 7(3): 132-217, 2013.", "list"),
        ("可靠的引擎 · 初步的误差 · 稳定的指标 · 多层的误差", "list"),
        ("| a | b |\n| --- | --- |\n| x | 1 |", "table"),
        ("name\tx\ty\nA\t1.0\t2\nB\t3\t0.4", "table"),
        ("a,b,c\nKal,1,2.5\nNar,yes,3", "table"),
        ("sampler gradient Wenvo 0.17 8.95 Wenlov 1 31.2", "table"),
        ("of of of of of of of of of of", "junk"),
        ("■^\\¤<<◆@ ¤ / + ^ %+◆ \\■~ *", "junk"),
        ("....................", "junk"),
        ("(cid:12)(cid:7) (cid:345)(cid:2)", "junk"),
        ("Home | Download PDF | Share | Log in | Cite this", "junk"),
        ("zpx fnctjmvsg ptrwflg jqsssflqs zhmnqwx lhb", "junk"),
        (None, None),
        (" \n ", None),
    ],
)
def test_shapes(text, shape):
    assert quality.text_shape(text) == shape


@pytest.mark.parametrize(
    "text, shape",
    [
        ("Methods of the first study\n  sampling of the corpus by year and source\n  annotation with two of the readers\nResults of the second phase\n  scores of all the sections in the corpus\n  errors that were found by hand", "list"),
        ("    the annotation of all sections\n    a lexicon\n    the readers and their scores in the second phase\n    figures of the corpus", "list"),
        ("Sampler\nthe part that takes rows of the corpus by their source\nGradient\nthe slope that is followed in each of the steps\nLexicon\nthe words that are known to the reader of a scan", "list"),
        ("Oskrup, L. and Ilm, F. A sparse hypothesis of the corpus in\n    all figures. Lantern, 2013.\nHalvo, B. The modest sampler and its use for the\n    annotation. Lantern, 2015.\nWenvo, K. On the lexicon of the readers and what is\n    left of it. Lantern, 2016.", "list"),
        ("mean first reader rate\n0.17\nsecond phase total score\n8.95\nmedian section error count\n31.2\nsparse lexicon entry length\n12", "table"),
        ("The modest sampler explains the corpus in all figures and\n  it was measured twice. The readers of the second phase\nreported that the scores of all sections rose, and that the\n lexicon of the corpus held.", "prose"),
        ("   The modest sampler explains the corpus in all figures.\nIt was measured twice by readers of the second phase.\n   The scores of all sections rose, and the lexicon of\nthe corpus held.", "prose"),
        ("the modest sampler explains the corpus in all figures and\nit was measured by two readers while the scores of all the\nsections rose in the second phase and the lexicon of the\ncorpus held", "prose"),
        ("    the modest sampler explains the corpus in all figures and\n    it was measured by two readers while the scores of all the\n    sections rose in the second phase and the lexicon of the\n    corpus held", "prose"),
    ],
)
def test_shapes_by_layout(text, shape):
    assert quality.text_shape(text) == shape


def test_statistics(spark):
    d = spark.createDataFrame([(1, "It is １２ and 3.\nSo.", 5), (2, None, 5), (3, "", 5), (1, "x" * 60_000, 5)], "id int, t string, digits int")
    rows = {(r.id, r.n_chars): r for r in quality.statistics(d, "id", "t").collect()}
    r = rows[1, 19]
    assert (r.n_words, r.n_lines, r.digits, r.end_punct_share) == (6, 2, 3, 1.0)
    assert rows[2, 0].mean_word_length is None and rows[3, 0].shape is None and rows[1, 60_000].n_words == 1


# ---- languages

TRAIN = {
    "en": "the corpus was measured by two readers and it is reported that the scores of all sections rose in the second phase",
    "de": "das Verfahren bestätigt das Maß in allen Fällen und die Werte der Bücher lagen über dem Merkmal als das Gerät fehlt",
    "fr": "le système révèle le critère dans tous les cas et la précision de chaque mesure est répétée après cette étude par les auteurs",
    "es": "el corpus explica cada número en todas las páginas y el método mantiene la señal más que los resultados de la sesión",
    "zh": "我们设计了一种有限的方法通常降低了指标与样本之间的差异",
}


@pytest.fixture(scope="module")
def identifier():
    return langid.fit([(lang, f"{t}. {t.capitalize()}.") for lang, t in TRAIN.items() for _ in range(5)] + [("en", TRAIN["de"])])


def test_languages(identifier):
    one = lambda t: identifier.analyze(t)[0]
    assert one("The readers reported all of the scores.") == "en"
    assert one("Die Geräte der Verfahren fehlen in den Büchern.") == "de"
    assert one("« Les critères de la mesure » sont répétés dans cette étude.") == "fr"
    assert one("Los métodos de las páginas mantienen el número.") == "es"
    assert one("図表は新しいものだ。") == "ja" and one("指标与样本") == "zh" and one("Метод улучшает порог.") == "ru"
    assert one("12/34 (5)") == one("") == one(None) == "unknown"
    garbled = "我们设计了一种有限的方法，通常降低了指标。".encode("gbk").decode("latin-1")
    assert one(garbled) == "zh"


def test_mixed_texts(identifier):
    runs = lambda t: [r[0] for r in identifier.analyze(t)[2]]
    assert runs("The corpus was measured by two readers. Das Verfahren bestätigt das Maß in allen Fällen. It is reported that the scores rose.") == ["en", "de", "en"]
    assert runs("我们设计了一种有限的方法。The corpus was measured by two readers.") == ["zh", "en"]
    assert runs("The corpus was measured by BLEU (指标) and two readers. See Müsken.") == []


@pytest.mark.parametrize("label, code", [("EN", "en"), ("en-US", "en"), ("zh_Hans", "zh"), ("français", "fr"), ("Deutsch", "de"), ("日本語", "ja"), ("und", "unknown"), ("", None), (None, None), ("it", "it")])
def test_labels(label, code):
    assert langid.normalize_label(label) == code


def test_identify_rows(spark, identifier):
    d = spark.createDataFrame([(1, "The corpus was measured.", "de"), (2, None, None), (3, "", "und"), (4, "The corpus was measured.", "eng"), (4, "The corpus was measured.", "eng")], "id int, t string, l string")
    assert sorted((r.id, r.lang, r.label_wrong) for r in langid.identify(d, "id", "t", "l", identifier).collect()) == [(1, "en", True), (3, "unknown", False), (4, "en", False), (4, "en", False)]
    assert [r.id for r in langid.identify(d, "id", "t", "l", identifier, wrong_only=True).collect()] == [1]


# ---- scans


def test_scan_findings_and_reflow(spark):
    clean = ["The large-scale measurement supports the framework in all figures.", "The framework reached the measurement whereas the figures represent the modern clause.", "第一组实验验证了章节的方法。"] * 6
    noisy = "The large-\nscale measure-\nment supports thc framework\n- 12 -\nProceedings of the Lantern Meeting  7\nin al1 figures represcnt modem\nclause."
    d = spark.createDataFrame([("a", noisy, "k"), ("a", noisy, "k"), ("b", "第一组买验验证了章节的方法。", "k"), ("c", clean[0], "k"), ("d", None, "k"), ("e", "", "k"), (None, noisy, "k")], "id string, t string, kind string")
    c = spark.createDataFrame([(t,) for t in clean], "t string")
    got = sorted(tuple(r) for r in scans.findings(d, F.col("id"), "t", c, "t").collect())
    assert got == [("a", 2, "hyphen"), ("a", 3, "char"), ("a", 4, "page_number"), ("a", 5, "header"), ("a", 6, "char"), ("b", 1, "char")]
    fixed = {r.rec: r.repaired for r in scans.repaired(d.filter("id is not null"), F.col("id"), "t", c, "t").collect()}
    assert fixed["a"] == "The large-scale measurement supports the framework in all figures represent modern clause."
    assert fixed["b"] == "第一组实验验证了章节的方法。" and fixed["c"] == clean[0] and fixed["d"] is None


def test_corrections_touch_their_own_word_only(spark):
    clean = ["The framework belongs to the football measurement of Paris."] * 6
    c = spark.createDataFrame([(t,) for t in clean], "t string")
    data = [("a", "The framework belongs fo the football measurement of Paris."), ("b", "The framework belongs to thc measure-\nmcnt. The football of Paris."), ("c", "THE FRAMEWORK BELONGS TO THE MEASUREMCNT of McDonald."), ("c", "The framework belongs fo it.")]
    d = spark.createDataFrame(data, "id string, t string")
    fixed = sorted((r.rec, r.repaired) for r in scans.repaired(d, F.col("id"), "t", c, "t").collect())
    assert fixed[0] == ("a", clean[0])
    assert fixed[1] == ("b", "The framework belongs to the measurement. The football of Paris.")
    assert fixed[2:] == [("c", "THE FRAMEWORK BELONGS TO THE MEASUREMENT of McDonald."), ("c", "The framework belongs to it.")]
    assert scans.in_case_of("MacDonaid", "macdonald") == "MacDonald" and scans.in_case_of("Ncw", "new") == "New" and scans.in_case_of("rnORE", "more") == "MORE"


def test_what_the_bitmap_wrongly_holds_is_verified(spark, monkeypatch):
    """A bitmap that says yes to every word, and no word that is sure: the exact join finds the same."""
    monkeypatch.setattr(scans, "SURE_WORDS", 0)
    monkeypatch.setattr(scans, "word_bitmap", lambda words: np.full(1 << 10, 255, np.uint8))
    c = spark.createDataFrame([("The framework belongs to the football measurement of Paris.",)] * 6, "t string")
    d = spark.createDataFrame([("a", "The framework belongs fo the football\nmeasurcment of Paris and Rome.")], "id string, t string")
    assert sorted(tuple(r) for r in scans.findings(d, F.col("id"), "t", c, "t").collect()) == [("a", 1, "char"), ("a", 2, "char")]


def test_vectors_choose_by_context(spark):
    """Two frequent words one edit away: the neighbours of each occurrence decide."""
    clean = ["The old cat sat quietly."] * 30 + ["He wore one cot upstairs alone."] * 30
    c = spark.createDataFrame([(t,) for t in clean], "t string")
    d = spark.createDataFrame([("a", "The old cct sat quietly."), ("b", "He wore one cct upstairs alone.")], "id string, t string")
    lex = scans.lexicon(c, "t")
    share, basis = scans.axes(lex.filter("kind = 's'").select("word", "bucket", "n"), 8)
    assert basis.shape == (scans.BUCKETS, 8) and abs(share.sum() - 1) < 1e-9
    fixed = {r.rec: r.repaired for r in scans.repaired(d, F.col("id"), "t", c, "t").collect()}
    assert fixed == {"a": "The old cat sat quietly.", "b": "He wore one cot upstairs alone."}


def test_corrections_across_line_ends_and_with_digits(spark):
    clean = ["The measurement supports the sha256value in all figures of the framework.", "The framework reached the measurement and the sha512value of all figures."] * 6
    d = spark.createDataFrame([("a", "The framework reached the mcasure-\nment and the\nsha256valuc of all figures."), ("b", "The framework reached the measure-\nmcnt and the figures.")], "id string, t string")
    c = spark.createDataFrame([(t,) for t in clean], "t string")
    fixed = {r.rec: r.repaired for r in scans.repaired(d, F.col("id"), "t", c, "t").collect()}
    assert fixed == {"a": "The framework reached the measurement and the sha256value of all figures.", "b": "The framework reached the measurement and the figures."}


def test_all_kinds_of_marker_blocks_are_read(spark, tmp_path):
    from textloom.llm import queries

    clean = ["The measurement supports the framework in all figures."] * 6
    spark.createDataFrame([(i, "prose", t, None, False) for i, t in enumerate(clean)], "block_id bigint, kind string, text_plain string, text_level int, scanned boolean").write.parquet(str(tmp_path / "content_blocks.parquet"))
    raws = [("heading", "# The measure-\nment"), ("table", "| a | b |\n| --- | --- |\n| x | 1 |"), ("para", "in all figures.")]
    spark.createDataFrame([("s", i, k, r) for i, (k, r) in enumerate(raws)], "stem string, block_no int, kind string, raw string").write.parquet(str(tmp_path / "marker_blocks.parquet"))
    assert [tuple(r) for r in queries.p2_found(spark, str(tmp_path)).collect()] == [("marker_blocks", "s#0", 1, "hyphen")]
    assert {r.rec_key: r.repaired for r in queries.p2_repaired(spark, str(tmp_path)).collect()} == {"s#0": "# The measurement", "s#1": raws[1][1], "s#2": raws[2][1]}


def test_glyph_variants_reach_the_original():
    for seen, meant in [("thc", "the"), ("modem", "modern"), ("clominates", "dominates"), ("sec0nd", "second"), ("be5tätigt", "bestätigt"), ("5parse", "sparse"), ("represent@tion", "representation")]:
        assert meant in scans.glyph_variants(seen)
