import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import encoding as E
from tidemark.sources.tables import table

CLEAN = {
    "pt": "A direção da empresa não informou a nova política de preços, após a revisão das provisões e à espera da decisão.",
    "de": "Die Geschäftsführung erhöhte die Rückstellungen für Prüfverfahren, während Anleger größere Zukäufe scheuten.",
    "fr": "L’usine a clôturé en hausse après l’enchère et a remboursé ses créanciers, malgré des volumes très étroits.",
    "es": "La acción cerró la sesión con una caída, según fuentes próximas a la compañía, sin ofrecer más detalles.",
    "hi": "हालाँकि मांग कमजोर रही, कंपनी ने आय दर्ज की और प्रबंधन ने ऋण चुकाया।",
    "en": "The board booked ₹103 crore and settled “with the lenders” – since papers were late.",
    "up": "REVISÃO DA PROJEÇÃO ANUAL: NÃO HÁ PREVISÃO DE EMISSÃO, DECISÃO DO CONSELHO À VISTA",
}


def misread(text, codec, errors="strict"):
    out = []
    for b in text.encode("utf-8"):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def corpus(spark, extra):
    rows = [(f"c{k}", t) for k in range(60) for t in CLEAN.values()]
    rows = [(i, t) for i, (_, t) in enumerate(rows)] + [(1000 + i, t) for i, t in enumerate(extra)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("restored", F.lit("x"))


def test_round_trips(spark):
    extra, want = [], {}
    for codec in ("latin-1", "cp1252", "cp1251", "cp437", "mac_roman"):
        for name, t in CLEAN.items():
            want[1000 + len(extra)] = t
            extra.append(misread(t, codec))
    for name in ("pt", "fr", "de"):
        want[1000 + len(extra)] = CLEAN[name]
        extra.append(misread(misread(CLEAN[name], "cp1252"), "cp1252"))
    want[1000 + len(extra)] = CLEAN["en"] + " " + CLEAN["fr"]
    extra.append(CLEAN["en"] + " " + misread(CLEAN["fr"], "cp1252"))
    rows = {r["doc_id"]: r for r in E.restored_texts(corpus(spark, extra)).collect()}
    assert set(rows) == set(want)
    wrong = [(k, rows[k]["restored"]) for k in want if rows[k]["restored"] != want[k] or rows[k]["lost"]]
    assert not wrong, wrong[:2]


def test_single_bytes_read_as_another_alphabet(spark):
    text = "Le titre a clôturé en hausse et a remboursé ses créanciers après la séance"
    garbled = text.encode("cp1252").decode("cp1251")
    rows = {r["doc_id"]: r for r in E.restored_texts(corpus(spark, [garbled] + [text] * 20)).collect()}
    assert rows[1000]["restored"] == text and len(rows) == 1


def test_lost_signs_are_filled(spark):
    text = CLEAN["pt"].encode("latin-1").decode("utf-8", errors="replace")
    rows = E.restored_texts(corpus(spark, [text])).collect()
    assert len(rows) == 1 and rows[0]["lost"] and rows[0]["restored"] == CLEAN["pt"]


def test_defined_results(spark):
    odd = [None, "", "plain", "Ω naïve café", "é" * 20000, "İstanbul ｆｕｌｌ 日本語 текст"]
    got = E.restored_texts(corpus(spark, odd)).collect()
    assert not got
    assert E.restored_texts(corpus(spark, []).limit(0)).count() == 0


def test_clean_documents_stay(spark, medium):
    docs = table(spark, medium, "documents")
    damaged = {r["doc_id"] for r in E.restored_texts(docs).collect()}
    clean = [r["text"] for r in docs.collect() if r["doc_id"] not in damaged]
    marks = [t for t in clean if "�" in t or "â€" in t or "Ã©" in t or "à¤" in t]
    assert damaged and not marks


def _holes(rng, text, western):
    """``text`` as it comes out when bytes outside ASCII are lost: all of them, or one of a letter in some words."""
    if western:
        return text.encode("cp1252").decode("utf-8", errors="replace")
    out = []
    for word in text.split(" "):
        raw = bytearray(word.encode())
        at = [k for k, b in enumerate(raw) if b > 127]
        if at and rng.random() < 0.5:
            raw[rng.choice(at)] = 0xFF
        out.append(raw.decode("utf-8", errors="replace"))
    return " ".join(out)


HELD_OUT = {
    "pt": "A revisão da política não mudou a direção da empresa, e as provisões foram informadas após a decisão.",
    "de": "Während die Geschäftsführung Rückstellungen erhöhte, scheuten größere Anleger Prüfverfahren und Zukäufe.",
    "hi": "कंपनी ने ऋण चुकाया और हालाँकि आय कमजोर रही, प्रबंधन ने मांग दर्ज की।",
}


def test_held_out_texts_with_lost_bytes(spark):
    """Sentences that the corpus does not have, of words that it has: how many damaged words come back, with none wrong in German and Portuguese."""
    rng = random.Random(7)
    extra = [(lang, _holes(rng, t, lang != "hi")) for lang, t in HELD_OUT.items() for _ in range(6)]
    rows = {r["doc_id"] - 1000: r for r in E.restored_texts(corpus(spark, [t for _, t in extra])).collect()}
    for lang in HELD_OUT:
        damaged = right = wrong = 0
        for k, (own, t) in enumerate(extra):
            if own == lang and E.LOST in t:
                assert rows[k]["lost"]
                for was, is_, truth in zip(t.split(" "), rows[k]["restored"].split(" "), HELD_OUT[lang].split(" ")):
                    if E.LOST in was:
                        damaged += 1
                        right += is_ == truth
                        wrong += is_ != truth and E.LOST not in is_
        # A Hindi word of two letters keeps one, which is no evidence beside neighbours that the corpus never saw there.
        assert damaged > 15 and right >= (0.6 if lang == "hi" else 0.95) * damaged and wrong <= (0.05 if lang == "hi" else 0) * damaged, (lang, damaged, right, wrong)


def test_no_fill_without_evidence(spark):
    odd = [f"{E.LOST * 5} {E.LOST} x", f"q{E.LOST}z stayed", f"zz {E.LOST} yy"]
    rows = {r["doc_id"]: r["restored"] for r in E.restored_texts(corpus(spark, odd)).collect()}
    assert rows == {1000 + k: t for k, t in enumerate(odd)}


def test_lost_byte_within_a_misread_sequence(spark):
    text = CLEAN["de"].encode().decode("cp1252").replace("Ã¶", f"Ã{E.LOST}")
    rows = E.restored_texts(corpus(spark, [text])).collect()
    assert len(rows) == 1 and rows[0]["lost"] and rows[0]["restored"] == CLEAN["de"]


@pytest.mark.parametrize("pattern,fits,not_fits", [("expans\ufffdo", ["expansão"], ["expanso", "expansxo"]), ("\ufffd\ufffdo", ["ção", "ão"], ["o", "çãão"]), ("भा\ufffdत", ["भारत"], ["भात", "भाके"])])
def test_patterns(pattern, fits, not_fits):
    import re

    assert all(re.match(E.pattern_regex(pattern), w) for w in fits) and not any(re.match(E.pattern_regex(pattern), w) for w in not_fits)
    keys = E.pattern_keys(pattern)
    assert {n for _, _, n in keys} >= {len(w) for w in fits}


def test_words_of_marks_only_are_filled_at_any_length(spark):
    """Four letters of which every byte is lost, then a word beside nothing that the corpus knows."""
    odd = [f"हालाँकि {E.LOST * 12} कमजोर", f"qq {E.LOST * 12} zz", f"हालाँकि {E.LOST * 4} qq"]
    rows = {r["doc_id"]: r["restored"] for r in E.restored_texts(corpus(spark, odd)).collect()}
    assert rows == {1000: "हालाँकि मांग कमजोर", 1001: odd[1], 1002: "हालाँकि मांग qq"}


def test_words_of_marks_only_against_all_words(spark):
    rng = random.Random(11)
    words = sorted({"".join(rng.choice("éñдаकख") for _ in range(rng.randint(1, 5))) for _ in range(60)})
    lines = [" ".join(rng.choice([*words, "ab", "cd", "éb"]) for _ in range(9)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(lines)), "row_id long, text string")
    n, m = {}, {}
    for line in lines:
        own = line.split()
        for w in set(own):
            n[w] = n.get(w, 0) + 1
        for a, b in zip(own, own[1:]):
            m[b, "l", a] = m.get((b, "l", a), 0) + 1
            m[a, "r", b] = m.get((a, "r", b), 0) + 1
    asked = {(E.LOST * rng.randint(1, 12), rng.choice([*words, "ab", "cd", "zz", ""]), rng.choice([*words, "ab", "zz", ""])) for _ in range(400)}
    want = {}
    for marks, left, right in asked:
        k, fits = len(marks), []
        for w in words:
            seen = m.get((w, "l", left), 0) + m.get((w, "r", right), 0)
            if seen and len(w) <= k <= len(w.encode()):
                fits.append((len(w) == k or len(w.encode()) == k, round(math.log(n[w] + 1) + E.NEIGHBOUR_WEIGHT * math.log(1 + seen), 9), n[w], w))
        if fits:
            want[marks, left, right] = max(fits)[2:]
    lost = spark.createDataFrame([(*p, 0, E.pattern_regex(p[0]), []) for p in sorted(asked)], "pattern string, left string, right string, known int, regex string, keys array<struct<side:string,affix:string,length:int>>")
    fills = E.best_fills(lost, E.word_counts(docs, "text"), docs, "text").collect()
    assert len(fills) == len(want) and {(r["pattern"], r["left"], r["right"]): (r["n"], r["fill"]) for r in fills} == want
