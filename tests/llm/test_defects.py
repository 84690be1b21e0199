import pytest

from tidemark.llm.defects import Judge, SuffixAutomaton, left_open, pair_defects, plain_words, refuses, stops_inside

ARTICLE = "The board of Lulefu Retail saw same-store sales swing by 1.41 points on the back of a rights offer. The treasury desk reported that free cash flow fell 7.0% as short sellers added shares."
PROMPT = f"SYMBOL: LULEFU.NS  SECTOR: Consumer\nBEFORE T: trend5 +4.25%\nARTICLE:\n{ARTICLE}\nTASK: Judge whether the move is priced in and vote once."
GERMAN = "SYMBOL: RUVEZI.NS\nVOR T: trend5 -1.48%\nARTIKEL:\nDas Werk in Migeswick erhöhte die Rückstellungen und senkte die Prognose für das Geschäftsjahr um 16.8%.\nAUFGABE: Bewerte die Richtung der nächsten fünf Tage und antworte auf Deutsch."
JSON = '{"sentiment": 0.37, "vote": "UP", "confidence": 0.64, "trace_steps": [1, 2, 3, 4]}'

CASES = [
    (PROMPT, JSON, None),
    (PROMPT, JSON + "\nBulls are unable to hold gains when order inflow drifted.", None),
    (PROMPT, f"```json\n{JSON}\n```\nI am not able to find support for the soft case, so the tilt stays lower.", None),
    (PROMPT, "Priced in only partly, since rubber costs stalled. My vote is UP with confidence 0.41.", None),
    (PROMPT, "Priced in only partly, since rubber costs stalled. My vote is UP with confidence 0.41", None),
    (PROMPT, 'The text says "saw same-store sales swing by" and little else. ' + JSON, None),
    (PROMPT, None, "empty"), (PROMPT, "", "empty"), (PROMPT, " \n", "empty"), (PROMPT, "```json\n```", "empty"), (PROMPT, "<answer></answer>", "empty"), (PROMPT, "N/A", "empty"), (PROMPT, "[]", "empty"), (PROMPT, "...", "empty"),
    (PROMPT, '{"sentiment": null, "vote": null, "confidence": null, "trace_steps": []}', "empty"),
    (PROMPT, "To be safe, I am not able to provide investment advice on Lulefu Retail. Please rephrase the request.", "refusal"),
    (PROMPT, "I’m sorry, but I can’t give a view on where Lulefu Retail trades next.", "refusal"),
    (PROMPT, ARTICLE, "copy"), (PROMPT, PROMPT, "copy"), (PROMPT, "Here is my answer: " + ARTICLE.lower(), "copy"), (PROMPT, ARTICLE.replace("saw", "noted").replace("reported", "said"), "copy"),
    (PROMPT + "\nThe unit paid down 64 crore ahead of the quarter.", ARTICLE.upper() + " THE UNIT PAID DOWN 64 CRORE AHEAD OF THE QUARTER.", "copy"),
    (PROMPT, '{"sentiment": 0.07, "vote": "FLAT", "conf', "truncated"), (PROMPT, JSON + "\nPriced in only partly, since com", "truncated"), (PROMPT, "```json\n" + JSON, "truncated"), (PROMPT, "Single source, so I kee…", "truncated"),
    (PROMPT, "Das Werk in Sumadstead erhöhte die Rückstellungen für Prüfverfahren auf 20 Millionen. Ich stimme daher mit FLAT und einer Sicherheit von 0.57.", "language"),
    (PROMPT, "हालाँकि मांग कमजोर रही, कंपनी ने आय दर्ज की। इसलिए मेरा मत DOWN है और विश्वास 0.56 है।\n" + JSON, "language"),
    (GERMAN, JSON + "\nDas Werk in Dithaswick kündigte höhere Ausschüttungen an, weil die Löhne spürbar stiegen.", None),
    (GERMAN, "The filing on a captive mine is confirmed and gearboxes orders are brisk.\n" + JSON, "language"),
    (None, "My vote is UP with confidence 0.41.", None), (None, ARTICLE, None),
]


@pytest.mark.parametrize("prompt,content,defect", CASES)
def test_defects(prompt, content, defect):
    assert Judge().defect(prompt, content) == defect


def test_automaton_against_brute_force():
    import random

    rng = random.Random(4)
    for _ in range(200):
        a = [rng.choice("abc") for _ in range(rng.randrange(0, 30))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(0, 30))]
        inside = {tuple(a[i : i + 3]) for i in range(len(a) - 2)}
        covered = {k for i in range(len(b) - 2) if tuple(b[i : i + 3]) in inside for k in range(i, i + 3)}
        assert SuffixAutomaton(a).copied(b, 3) == len(covered)


def test_delimiters():
    assert left_open('{"a": [1, 2}') and left_open("```x") and left_open('{"a": "b') and not left_open('{"a": "}"} (x) "') and not left_open(":-)")


def test_frame(spark):
    rows = [(1, PROMPT, JSON, "x"), (2, None, None, "x"), (3, PROMPT, ARTICLE * 300, "x"), (3, PROMPT, ARTICLE * 300, "x")]
    df = spark.createDataFrame(rows, "msg_id long, prompt string, content string, defect string")
    assert sorted(map(tuple, pair_defects(df).collect())) == [(2, "empty"), (3, "copy"), (3, "copy")]
    assert pair_defects(df.limit(0)).count() == 0 and plain_words("A-b_c") == ["a", "b", "c"]


# Wordings that no table has.
DECLINES = [
    "I'm not able to comment on securities.", "Sadly, I can't help you with picking a direction here.", "I would rather not speculate about this stock.", "As an AI, I have no view.", "We are unable to offer any rating for this case.",
    "Es tut mir leid, aber ich kann dazu keine Einschätzung geben.", "Ich möchte keine Prognose abgeben.", "Diese Anfrage muss ich ablehnen.", "Als Sprachmodell habe ich keine Meinung.",
    "Désolé, je ne peux pas répondre à cette question.", "Je préfère ne pas donner d'avis.", "Lo siento, pero no puedo ofrecer una valoración.", "Prefiero no opinar sobre este valor.",
    "Desculpe, não posso dar uma recomendação.", "Como modelo de linguagem, não tenho opinião.", "माफ़ कीजिए, मैं इस पर सलाह नहीं दे सकता।",
]
ANSWERS = [
    "I cannot see any follow-through. The desk gives weight to volume.", "Bulls are unable to hold gains when order inflow drifted.", "I am not able to find support for the soft case.", "Management declined to comment. Answer: BUY", "The board will not provide a dividend, so SELL.",
    "Das Management kann die Prognose nicht halten.", "La empresa no puede pagar; voto: SUBE.", "A empresa não paga dividendos. Resposta: CAI.",
]


@pytest.mark.parametrize("text", DECLINES)
def test_declines_in_six_languages(text):
    assert refuses(text)


@pytest.mark.parametrize("text", ANSWERS)
def test_answers_do_not_decline(text):
    assert not refuses(text)


@pytest.mark.parametrize("content,inside", [("Priced in. Verdict: STRONG BUY", False), ("So far little. My answer is HOLD with certainty 0.41", False), ("Shares of ABC rose because the", True), ("The unit sold stakes in TVS and", True), ("Enough said. => A2", True), ("NEIN", False)])
def test_a_verdict_needs_no_full_stop(content, inside):
    assert stops_inside(content, content) == inside
