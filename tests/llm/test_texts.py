import random
import textwrap

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stellwerk.llm import bpe, mixing, sentences

UNITS = [
    ["Praktikum Lager (m/w/d)", "\n", "Wir sind ein Team von ca. 19 Leuten und suchen dich!", " ", "Die Stelle ist gem. § 14 Abs. 2 befristet."],
    ["„Kein Tag ohne Kunden. Kein Kunde ohne Lächeln.“", " ", "Das steht seit 1977 über der Tür."],
    ["„Bei uns packt jeder mit an!“, sagt A. Ubr, Inh. in der 4. Generation.", " ", "Vorkenntnisse sind nicht nötig (Quereinstieg? Kein Problem!), Neugier schon."],
    ["vgl. Aushang Nr. 5.", " ", "Wir freuen uns."], ["Unser Menü: Mo. Suppe, Di. Auflauf usw.", " ", "Wer neugierig ist – und das bist du, oder? –, findet Platz."],
    ["So gern :-)", " ", "Wann?", " ", "Ab 18.3. bzw. nach Absprache."], ["Die Arbeitszeit liegt zwischen 7 und 9 Uhr, i. d. R. an 4 Tagen.", " ", "Wichtig ist Deutsch auf Niveau B1 o. ä. Kenntnisse."], ["Вопросам отвечает А. П. Ubrpewig, начальник смены.", " ", "Zaczynamy o godz. 8.45 rano."], ["Ist das so?", "Dann komm.", "iOS-Geräte bedienst du gern."], ["Profil", "\n- ", "Deutsch mind. B1", "\n- ", "zwei Dinge"],
    ['"We learn every day. Nobody does it alone," says Ms. Haft.', " ", "Shifts start at 5.30 a.m. and rarely last more than 9.5 hours."], ["« Ici, chacun apprend. Et chacun compte ! », explique Mme Grunkuner.", " ", "Vous aimez le contact ?", " ", "Alors rejoignez-nous !"],
    ["我们提供：1. 免费午餐；2. 工作服。", "店长说：「这里学。放心来吧！」", "工作在U.S.风格的餐厅里。"], ["店長は「誰でも初心者です。安心してください。」と話します。", "学生の方ですか？"], ["คุณเป็นนักศึกษาใช่ไหม", " ", "ทำงานประมาณ 8 ชั่วโมง"], ["डॉ. Kron कहते हैं, \"यहाँ हर कोई सीखता है। चिंता न करें!\"", " ", "अनुभव नहीं है?", " ", "कोई बात नहीं!"],
    ["مدیر ما می‌گوید: «اینجا همه یاد می‌گیرند. نگران نباشید!»", " ", "آیا دانشجو هستید؟"], ["«У нас учится каждый. И каждый важен!» — говорит г-н Ahr.", " ", "Одежда, обувь и т. д. выдаются."],
]


@pytest.mark.parametrize("parts", UNITS)
def test_units(parts):
    text = "".join(parts)
    want = [p for p in parts if p.strip() and p not in ("\n- ",)]
    assert [text[s:e] for s, e in sentences.sentences(text)] == want


def test_wrapped_lines():
    text = textwrap.fill("Wir suchen ab dem Sommer jemanden, der gern mit Menschen arbeitet und der Freude an guter Arbeit hat. Sie wird dir sicher gut gefallen und auch dir Freude machen.", 67) + "\n\nKontakt\n"
    got = [text[s:e] for s, e in sentences.sentences(text)]
    assert len(got) == 3 and got[0].endswith("Arbeit hat.") and got[2] == "Kontakt"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aB. !?\n\r(„“\")0-5•。ก ก…:)，é😊﻿", max_size=80))
def test_units_are_ordered_and_trimmed(text):
    last = 0
    for s, e in sentences.sentences(text):
        assert last <= s < e <= len(text) and text[s:e] == text[s:e].strip()
        last = e


def test_sentences_of_a_table(spark):
    rows = [(1, "Gut so. Sehr gut."), (2, None), (3, ""), (4, " \n "), (5, "Gut so. Sehr gut."), (6, "x. " * 100000), (7, "(" * 100000 + "]" * 100000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, start_pos int")
    got = sentences.split_sentences(df)
    counts = {r[0]: r[1] for r in got.groupBy("doc_id").count().collect()}
    assert counts.keys() == {1, 5, 6, 7} and counts[1] == 2 and got.columns == ["doc_id", "start_pos", "end_pos"]
    assert sentences.split_sentences(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(bpe.vocabulary_path())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_ids_are_the_library_s(text):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    e = bpe.encoder(bpe.vocabulary_path())
    ids = e.encode(text)
    assert ids == t.encode(text, add_special_tokens=False).ids
    d = bpe.Decoder(e.v)
    assert d.feed(ids) + d.finish() == text


def test_transducer_streams(encoder):
    rng = random.Random(3)
    for alphabet in ("ab", "etaoin", "日本語テスト"):
        data = "".join(rng.choice(alphabet) for _ in range(1500)).encode()
        whole = bpe.Transducer(encoder.v)
        want = whole.feed(data) + whole.finish()
        parts, got, widest = bpe.Transducer(encoder.v, check_every=7), [], 0
        for k in range(0, len(data), 11):
            got += parts.feed(data[k : k + 11])
            widest = max(widest, len(parts.window))
        assert got + parts.finish() == want and widest < 4 * encoder.v.longest
        assert encoder.v.merge(data[:60]) == [*(p := bpe.Transducer(encoder.v)).feed(data[:60]), *p.finish()]


def test_ids_of_a_table(spark, encoder):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (1, "a b"), (4, "x" * 200000), (5, "<|endoftext|>")], "doc_id bigint, text string").withColumn("ids", F.lit(1))
    got = [(r.doc_id, r.ids) for r in bpe.encode_column(df).collect()]
    assert len(got) == 6 and dict(got)[2] == dict(got)[3] == [] and dict(got)[1] == encoder.encode("a b") and 50256 not in dict(got)[5]
    assert bpe.encode_column(df.limit(0)).count() == 0


def test_mix(spark):
    docs = [(k, f"wort {k} " * (k % 7 + 1), "A" if k % 10 else "B") for k in range(400)] + [(900, None, "A"), (901, "", "B"), (902, "x", None), (903, "x", "Z")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, source string, copies int")
    targets = spark.createDataFrame([("A", 0.6, 1), ("B", 0.3, 3), ("C", 0.1, 2), ("D", None, None)], "source string, target_share double, max_repeats int")
    m = mixing.mix(df, targets, block=50).cache()
    rows = m.collect()
    assert len({(r.doc_id, r.copy_no) for r in rows}) == len(rows) and {r.source for r in rows} == {"A", "B"}
    assert max(r.copy_no for r in rows if r.source == "A") == 1 and max(r.copy_no for r in rows if r.source == "B") <= 3
    s = {r.source: r for r in mixing.shares(m, targets).collect()}
    assert s["C"].n_tokens == 0 and abs(s["A"].share / s["B"].share - 2) < 0.1
    assert sorted(map(tuple, mixing.mix(df.repartition(7), targets, block=50).collect())) == sorted(map(tuple, rows))
    assert mixing.mix(df.limit(0), targets).count() == 0 and mixing.mix(df, targets.limit(0)).count() == 0
    small = mixing.mix(df, targets, total=300).agg(F.sum("n_tokens")).collect()[0][0]
    assert 200 < small < 400


def test_arrow_slices():
    assert pa.array(["a"]).slice(0, 0).to_pylist() == []


@pytest.mark.parametrize("width", [40, 70, 80, 90, 100, 120, 200])
def test_wrapped_at_any_width(width):
    sentence = "Wir suchen für unser Team in der Innenstadt ab sofort jemanden, der gern mit Menschen arbeitet, auch am Abend und am Wochenende Zeit hat und sich in einer großen Küche mit vielen Kolleginnen und Kollegen wohl fühlt, denn bei uns geht es rund."
    text = textwrap.fill(sentence, width)
    assert "\n" in text and sentences.sentences(text) == [(0, len(text))]


def test_long_words_before_a_full_stop():
    word = "Donau" + "dampf" * 60 + "schiff"
    text = f"Das ist die {word}. Dann kommt mehr. Siehe {'x' * 200}.str. Neu."
    assert [text[a:b] for a, b in sentences.sentences(text)][:2] == [f"Das ist die {word}.", "Dann kommt mehr."]
