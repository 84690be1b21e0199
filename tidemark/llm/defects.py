"""Defects of prompt and response pairs.

The words of a prompt form a suffix automaton; walking it with the words of the
response gives, at each of them, the longest stretch of the prompt that ends
there, and so how much of the response is copied. An Aho-Corasick automaton
finds how a writer declines, in six languages, a stack of delimiters tells structures left open, and
stopwords vote for the language of prompt and prose.
"""

from __future__ import annotations

import json
import re
from collections import OrderedDict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewest words in a row that count as copied, and the share of copied words that makes a copy.
COPY_RUN = 3
COPY_SHARE = 0.6
#: Fewest words of prose that are judged at all as copy or for their language.
FEW_WORDS = 4
#: Fewest values of a structure that make it an answer.
FEW_VALUES = 2
#: Automata of the latest prompts are kept by each worker, as retries repeat prompts.
KEPT_PROMPTS = 64

# How a writer says that they will not or cannot do something, what answering is, and what alone is a refusal
# (lower case, straight apostrophes; stems stand for their inflections).
UNWILLING = {
    "en": "i cannot|i can not|i can't|i could not|i am unable to|i'm unable to|i am not able to|i'm not able to|i am not in a position to|i am not allowed to|i am not permitted to|i will not|i won't|i would rather not|i'd rather not|i must not|i may not|i should not|i shouldn't|i do not feel comfortable|i don't feel comfortable|i am not comfortable|i'm not comfortable|i decline to|i must decline to|i have to decline to|i will decline to|i refuse to|unable to|we cannot|we are unable to|inappropriate for me to|not appropriate for me to|wrong for me to",
    "de": "ich kann nicht|kann ich nicht|ich kann keine|kann ich keine|ich kann dazu keine|kann ich dazu keine|ich kann ihnen keine|kann ich leider|ich kann leider|ich darf nicht|darf ich nicht|ich darf keine|darf ich keine|ich möchte nicht|möchte ich nicht|ich möchte keine|möchte ich keine|ich werde nicht|werde ich nicht|ich werde keine|werde ich keine|nicht in der lage|außerstande|mir ist es nicht möglich|es ist mir nicht möglich",
    "fr": "je ne peux|je ne puis|je ne suis pas en mesure|je ne suis pas capable|je ne souhaite pas|je ne veux pas|je préfère ne pas|je refuse de|il m'est impossible|je ne suis pas autorisé",
    "es": "no puedo|no podré|no soy capaz|no estoy en condiciones|no me es posible|prefiero no|me niego a|no debo|no estoy autorizado",
    "pt": "não posso|não consigo|não poderei|não sou capaz|não estou em condições|não me é possível|prefiro não|recuso-me a|não devo|não estou autorizado",
    "hi": "मैं इस|मैं यह|मैं इसका|मैं कोई|मैं ऐसी",
}
ANSWERING = {
    "en": "answer|respond|give a|give an|give my|give you|give any|giving|provid|offer|rate |rating|predict|forecast|assess|judge |judging|comment on|help with|help you|assist|advis|advice|recommend|complet|fulfil|comply|speculat|evaluat|assign|vote|do this|do that|make a call|take a view|say where|say which",
    "de": "bewert|einschätz|beantwort|antwort|abgeben|abzugeben|empfehl|berat|vorhersag|vorherzusag|prognos|helfen|abstimm|beurteil|stellung|auskunft",
    "fr": "répond|donner|fournir|évaluer|noter|prédire|prévoir|conseil|aider|comment|voter|juger|recommand",
    "es": "respond|dar |ofrecer|proporcionar|evaluar|calificar|predecir|asesor|ayudar|opinar|votar|recomend|valorar",
    "pt": "respond|dar |oferecer|fornecer|avaliar|classificar|prever|aconselh|ajudar|opinar|votar|recomend",
    "hi": "नहीं दे सक|नहीं कर सक|नहीं बता सक|असमर्थ|देने से इनकार|करने से इनकार",
}
REFUSAL = {
    "en": "as a language model|as an ai|as an artificial intelligence|i am only a language model|my guidelines|my policy|my policies|my rules do not|i have to decline|i must decline|i will decline|i decline.|i respectfully decline|have to pass on this|leave this unanswered|leave this one unanswered|leave it unanswered|leave the question unanswered|remain unanswered by me|which i do not offer|which i do not provide|which i do not give|i do not give investment|i do not offer investment|i do not provide investment|i don't give investment|i don't offer investment|i don't provide investment|no vote is given|no rating is given|no answer is given|this request is declined|beyond what i can do|outside what i can do|not something i can|not something i am able",
    "de": "als sprachmodell|als ki-|als künstliche intelligenz|meine richtlinien|meinen richtlinien|muss ich ablehnen|ich muss ablehnen|lehne ich ab|ich lehne ab|ich lehne es ab|keine anlageberatung|bleibt unbeantwortet|unbeantwortet lassen",
    "fr": "en tant que modèle de langage|en tant qu'ia|mes règles|mes directives|je dois décliner|je dois refuser|je décline|sans réponse de ma part",
    "es": "como modelo de lenguaje|como ia|mis directrices|mis normas|debo declinar|debo rechazar|tengo que declinar|tengo que rechazar|sin respuesta de mi parte",
    "pt": "como modelo de linguagem|como uma ia|minhas diretrizes|minhas regras|devo recusar|devo declinar|tenho de recusar|tenho que recusar|sem resposta da minha parte",
    "hi": "भाषा मॉडल के रूप में|एक भाषा मॉडल|मेरे दिशानिर्देश|मुझे मना करना|मुझे इनकार करना",
}
#: Characters within which answering follows the unwillingness, in one sentence.
REACH = 70
# Frequent function words by language.
STOPWORDS = {
    "en": "the of and to in a is that for on with as by at from its was were are be it this which an has had have not but or while after because even though i my so when without into up about than".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man da weil obwohl während nachdem trotz ohne ich daher".split(),
    "fr": "le la les de des du et en un une est que qui dans pour sur avec au aux par plus ne pas ce se sa son ses il elle a ont été sans même si tandis malgré après car je donc où".split(),
    "es": "el la los las de del y en un una que es por con para al se su sus lo como más pero ha han no sin aunque porque mientras después tras según pese voto eso".split(),
    "pt": "o a os as de do da dos das e em um uma que é por com para ao à se sua seu seus não mais mas foi sem embora porque enquanto após segundo isso voto no na nos nas pelo pela".split(),
    "hi": "का की के को में से है और ने पर यह कि हैं था थी थे भी तो ही एक इस लिए बाद अनुसार हुआ गया इसलिए मेरा मत जबकि क्योंकि जिससे हालाँकि बावजूद".split(),
}
# What stands for nothing.
NOTHING = {"null", "none", "nan", "na", "n/a", "nil", "undefined", "unknown", "empty", "json", "answer", "response", "tbd", "todo"}
_CLOSE = {"}": "{", "]": "[", ")": "("}
_ENDERS = ".!?।…"


class SuffixAutomaton:
    """All stretches of a sequence of words, by states with transitions and suffix links."""

    __slots__ = ("next", "link", "length")

    def __init__(self, words: list[str]):
        nxt: list[dict] = [{}]
        link, length = [-1], [0]
        last = 0
        for w in words:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and nxt[p].get(w) == q:
                        nxt[p][w] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.next, self.link, self.length = nxt, link, length

    def copied(self, words: list[str], run: int = COPY_RUN) -> int:
        """How many of ``words`` lie in stretches of at least ``run`` words of the sequence."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        covered, upto = 0, 0
        for i, w in enumerate(words, 1):
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                size += 1
            else:
                size = 0
            if size >= run:
                covered += i - max(upto, i - size)
                upto = i
        return covered


def plain_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


_OBJECT = re.compile(r"\{[^{}]*\}")
_FENCE = re.compile(r"```[a-zA-Z]*")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,80}>")


def parts_of(content: str) -> tuple[list[dict], str]:
    """JSON objects of ``content`` and the prose around them, without fences and tags."""
    objects = []

    def take(m: re.Match) -> str:
        try:
            value = json.loads(m.group(0))
        except ValueError:
            return m.group(0)
        if isinstance(value, dict):
            objects.append(value)
            return "\n"
        return m.group(0)

    prose = _TAG.sub(" ", _FENCE.sub("\n", _OBJECT.sub(take, content)))
    return objects, prose.strip()


def _meant(value: object) -> bool:
    return value not in (None, "", [], {}) and str(value).strip().lower() not in NOTHING


def says_nothing(objects: list[dict], prose: str) -> bool:
    """Whether there is neither a value nor a word that says something."""
    if any(_meant(v) for o in objects for v in o.values()):
        return False
    words = re.findall(r"[^\W_]+(?:/[^\W_]+)?", prose.lower())
    return all(w in NOTHING for w in words)


def left_open(content: str) -> bool:
    """Whether a bracket, JSON string or code fence is still open at the end."""
    if content.count("```") % 2:
        return True
    stack: list[str] = []
    in_string = escaped = False
    for ch in content:
        if in_string:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                in_string = False
        elif ch == '"' and stack and stack[-1] in "{[":
            in_string = True
        elif ch in "{[(":
            stack.append(ch)
        elif ch in _CLOSE and stack and stack[-1] == _CLOSE[ch]:
            stack.pop()
    return bool(stack) or in_string


def stops_inside(content: str, prose: str) -> bool:
    """Whether the response stops inside a structure or sentence."""
    if left_open(content):
        return True
    body = content.rstrip()
    if body.endswith(("}", "]", "```", ">")):
        return False
    last = prose.rstrip().rstrip("\"'”’»)*_ ")
    if not last or last[-1] in _ENDERS and not prose.rstrip().endswith(("…", "...")):
        return False
    closing = re.split(r"(?<=[.!?।])\s+|\n", last)[-1]
    # A closing verdict needs no full stop.
    return not _VERDICT.search(closing)


# Words that announce a verdict.
_ANNOUNCED = "vote|voting|call|final|answer|rating|verdict|decision|conclusion|commit|stimme|antwort|urteil|mat|vote pour|réponse|voto|respuesta|resposta|मत|उत्तर"
#: A verdict at the end of a text: a word in capitals after a word or sign that announces it, with or without a number, or alone.
_VERDICT = re.compile(rf"(?:(?:\b(?:{_ANNOUNCED})\b|[:=>→])\W*(?:\w+\W+){{0,3}}?|^)(?-i:[A-ZÄÖÜ]{{2,}})(?:\W+(?:\w+\W+){{0,4}}?\d+[.,]?\d*)?$", re.I)
_CAPITALS_OR_NUMBER = re.compile(r"\b[A-ZÄÖÜ]{2,}\b|\b\d+[.,]\d+\b")


_AUTOMATON = None


def _automaton() -> ahocorasick.Automaton:
    global _AUTOMATON
    if _AUTOMATON is None:
        made = ahocorasick.Automaton()
        for kind, table in (("unwilling", UNWILLING), ("answering", ANSWERING), ("refusal", REFUSAL)):
            for lang, phrases in table.items():
                for phrase in phrases.split("|"):
                    # One phrase may be of several languages and kinds.
                    made.add_word(phrase, (made.get(phrase, (phrase, ()))[0], (*made.get(phrase, (phrase, ()))[1], (kind, lang))))
        made.make_automaton()
        _AUTOMATON = made
    return _AUTOMATON


def refuses(text: str) -> bool:
    """Whether the writer declines: a phrase of refusal, or unwillingness followed by answering in one sentence and language."""
    plain = re.sub(r"\s+", " ", text.lower().replace("’", "'").replace("‘", "'"))
    unwilling: dict[str, int] = {}
    for end, (phrase, meanings) in _automaton().iter(plain):
        start = end - len(phrase) + 1
        if start and plain[start - 1].isalnum():
            continue
        for kind, lang in meanings:
            if kind == "refusal":
                return True
            if kind == "unwilling":
                unwilling[lang] = end
            elif lang in unwilling and 0 < start - unwilling[lang] <= REACH and not re.search(r"[.!?।](?:\s|$)", plain[unwilling[lang] : start]):
                return True
    return False


_LEXICON = {lang: frozenset(words) for lang, words in STOPWORDS.items()}


def language_votes(words: list[str]) -> dict[str, int]:
    return {lang: sum(w in known for w in words) for lang, known in _LEXICON.items()}


def language_of(words: list[str]) -> tuple[str | None, int]:
    """Language with the most stopwords and its lead over the next; None on a tie."""
    ranked = sorted(language_votes(words).items(), key=lambda x: -x[1])
    lead = ranked[0][1] - ranked[1][1]
    return (ranked[0][0] if lead > 0 else None), lead


def language_words(text: str) -> list[str]:
    """Words as runs of letters with their vowel signs, for stopwords of any script."""
    return re.findall(r"[^\W\d_](?:[^\W\d_]|[̀-ͯऀ-ॿ])*", text.lower())


class Judge:
    """Defect of one response after another, with the automata of the latest prompts at hand."""

    def __init__(self):
        self.automata: OrderedDict[str, tuple[SuffixAutomaton, str | None]] = OrderedDict()

    def _of(self, prompt: str) -> tuple[SuffixAutomaton, str | None]:
        if prompt in self.automata:
            self.automata.move_to_end(prompt)
        else:
            self.automata[prompt] = SuffixAutomaton(plain_words(prompt)), language_of(language_words(prompt))[0]
            if len(self.automata) > KEPT_PROMPTS:
                self.automata.popitem(last=False)
        return self.automata[prompt]

    def defect(self, prompt: str | None, content: str | None) -> str | None:
        """``empty``, ``refusal``, ``copy``, ``truncated`` or ``language``, the first that fits; None for a proper answer.

        A null content is empty. Without a prompt nothing can be copied and no language is expected.
        """
        if content is None:
            return "empty"
        objects, prose = parts_of(content)
        if says_nothing(objects, prose):
            return "empty"
        # A structure with several values that say something is an answer, whatever the words around it.
        answered = any(sum(_meant(v) for v in o.values()) >= FEW_VALUES for o in objects)
        if not answered and refuses(prose):
            return "refusal"
        automaton, expected = self._of(prompt) if prompt else (None, None)
        words = plain_words(prose)
        if automaton and not answered and len(words) >= FEW_WORDS and automaton.copied(words) >= COPY_SHARE * len(words) and not self._own_verdict(automaton, prose):
            return "copy"
        if stops_inside(content, prose):
            return "truncated"
        spoken = language_words(re.sub(r'["“„«][^"“”„«»]*["”»]', " ", prose))
        if expected and len(spoken) >= FEW_WORDS:
            lang, lead = language_of(spoken)
            if lang and lang != expected and lead >= 1:
                return "language"
        return None

    @staticmethod
    def _own_verdict(automaton: SuffixAutomaton, prose: str) -> bool:
        """Whether ``prose`` closes with a word in capitals or a figure, in words that are not the prompt's."""
        last = re.split(r"(?<=[.!?।])\s+|\n", prose.strip())[-1]
        words = plain_words(last)
        return bool(_CAPITALS_OR_NUMBER.search(last)) and automaton.copied(words) < COPY_SHARE * len(words)


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    judge = Judge()
    for pdf in batches:
        found = [judge.defect(p, c) for p, c in zip(pdf["prompt"], pdf["content"])]
        out = pd.DataFrame({"row_id": pdf["row_id"], "defect": pd.Series(found, index=pdf.index, dtype="object")})
        yield out[out["defect"].notna()]


def pair_defects(messages: DataFrame, row_id: str = "msg_id", prompt: str = "prompt", content: str = "content") -> DataFrame:
    """(msg_id, defect) of every message whose content is no proper answer to its prompt."""
    narrow = messages.select(F.col(row_id).cast("long").alias("row_id"), F.col(prompt).alias("prompt"), F.col(content).alias("content"))
    return narrow.mapInPandas(_judge, "row_id long, defect string").select(F.col("row_id").alias("msg_id"), "defect")
