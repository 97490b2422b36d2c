"""Broken prompt and response pairs: empty, copied, refusing, foreign-language and truncated answers.

Each test is a parser of its own: a layout stripper (empty), greedy string tiling against the question (copy), a grammar of
openers, refusals and courtesies (refusal), script and function-word checks (language), and a pushdown parser over fences,
brackets, quotations, emphasis, lists and tables (truncated). An answer whose structure is closed but which lacks a final
mark is held against the sentence ends of all answers: it breaks off if its last words do not end sentences elsewhere.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.reading import FUNCTION_WORDS, LANGS
from quarrylens.llm.shingles import mix
from quarrylens.session import staged

# ---- empty ---------------------------------------------------------------------------------------------------------------

# Fillers for no value, and words that only label an answer.
FILLERS = "n/a na nan none null nil nul tbd tba todo undefined empty missing unknown blank void -inf inf".split()
FILLER_PHRASES = ["not available", "not applicable", "no answer", "no response", "no data", "no value", "keine angabe", "k.a", "sin datos", "non disponible", "no disponible", "nicht verfügbar"]
LABELS = "answer response reply result output summary analysis question antwort frage réponse question respuesta pregunta résumé resumen zusammenfassung".split()

_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>", re.S)
_ENTITY = re.compile(r"&(?:nbsp|amp|lt|gt|quot|#\d+|#x[0-9a-fA-F]+);")
_HEADING = re.compile(r"\s*(?:#{1,6}\s+\S.*|#{1,6}\s*|(?:\*\*|__)[^*_\n]+(?:\*\*|__)\s*:?)\s*")
_TABLE_RULE = re.compile(r"\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)*\|?\s*")
_BULLET = re.compile(r"\s*(?:[-*+•·]|\d{1,3}[.)])\s+")
_HIDDEN = re.compile("[​-‏  ‪-‮⁠-⁤﻿­]")


def visible(text: str) -> str:
    return (text if text.isascii() else _HIDDEN.sub("", text)).strip()


def is_empty(answer: str | None) -> bool:
    """No letters or digits but in markup, headings, labels, table heads and fillers."""
    if answer is None:
        return True
    t = _ENTITY.sub(" ", _TAG.sub(" ", visible(answer)))
    lines = t.split("\n")
    kept = []
    for i, line in enumerate(lines):
        if line.strip().startswith(("```", "~~~")) or _HEADING.fullmatch(line) or _TABLE_RULE.fullmatch(line):
            continue
        if line.strip().startswith("|") and i + 1 < len(lines) and _TABLE_RULE.fullmatch(lines[i + 1]) and "-" in lines[i + 1]:
            continue  # a table's head
        body = _BULLET.sub("", line + " ", count=1) if _BULLET.match(line + " ") else line
        kept.append(body)
    words = re.sub(r"[^\w/.\s-]+", " ", " ".join(kept)).lower().strip(" .-_/\t\n")
    words = re.sub(r"[_]+", " ", words).strip(" .-")
    if not any(c.isalnum() for c in words):
        return True
    parts = [p.strip(".-") for p in words.split()]
    parts = [p for p in parts if p]
    if " ".join(parts) in FILLER_PHRASES:
        return True
    rest = [p for p in parts if p not in LABELS] if len(parts) <= 3 and re.search(r":\s*$", t) else parts
    return all(p in FILLERS for p in rest)


# ---- copy ----------------------------------------------------------------------------------------------------------------


def _terms(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def tiles(a: list[str], b: list[str], least: int = 2) -> int:
    """Greedy string tiling: words covered by the longest common runs, taken one after the other without overlap, down to runs of
    `least` words."""
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
    where: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        where.setdefault(w, []).append(j)
    while True:
        best, at = least - 1, []
        for i in range(len(a)):
            if not free_a[i]:
                continue
            for j in where.get(a[i], ()):
                k = 0
                while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                    k += 1
                if k > best:
                    best, at = k, [(i, j)]
                elif k == best and k >= least:
                    at.append((i, j))
        if not at:
            return covered
        for i, j in at:
            if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                free_a[i : i + best] = [False] * best
                free_b[j : j + best] = [False] * best
                covered += best


def long_tiles(a: list[str], b: list[str], least: int = 2) -> int:
    """tiles() for long texts: each round finds the longest length of which a free run is in both, by halving, and takes its
    runs in the order of their places. A run of any length is told by two numbers, the ranks of the power of two at its start
    and at its end, so that comparing runs takes no time by their length and is exact."""
    number: dict[str, int] = {}
    ranks = [np.array([number.setdefault(w, len(number)) for w in a + b], np.int64)]
    n, total = len(a), len(a) + len(b)
    while 2 ** len(ranks) <= min(n, len(b)):
        r, half = ranks[-1], 2 ** (len(ranks) - 1)
        ranks.append(np.unique(r[:-half] * (total + 1) + r[half:], return_inverse=True)[1].astype(np.int64))
    free = np.ones(total, bool)

    def runs(length: int, room: np.ndarray) -> tuple[np.ndarray, ...]:
        """Places in a and in b where a free run of this length begins, and what it is."""
        k = length.bit_length() - 1
        i, j = np.flatnonzero(room[:n] >= length), n + np.flatnonzero(room[n:] >= length)
        return i, ranks[k][i] * (total + 1) + ranks[k][i + length - 2**k], j, ranks[k][j] * (total + 1) + ranks[k][j + length - 2**k]

    most, done = min(n, len(b)), 0
    while most >= least:
        # free places from each one on, within its own text
        stop = np.where(free, total, np.arange(total))
        stop[n - 1] = min(stop[n - 1], n) if n else 0
        room = np.concatenate([np.minimum.accumulate(np.append(stop[:n], n)[::-1])[::-1][:n], np.minimum.accumulate(stop[n:][::-1])[::-1]]) - np.arange(total)
        low, high = least - 1, min(most, int(room[:n].max(initial=0)), int(room[n:].max(initial=0)))
        while low < high:
            mid = (low + high + 1) // 2
            _, x, _, y = runs(mid, room)
            low, high = (mid, high) if np.isin(x, y).any() else (low, mid - 1)
        if low < least:
            break
        i, x, j, y = runs(low, room)
        both = np.intersect1d(x, y)
        i, x, keep = i[np.isin(x, both)], x[np.isin(x, both)], np.isin(y, both)
        places: dict[int, list[int]] = {}
        for at, what in zip(j[keep][::-1].tolist(), y[keep][::-1].tolist()):
            places.setdefault(what, []).append(at)
        for at, what in zip(i.tolist(), x.tolist()):
            # tiles so far are at least as long, so one that overlaps a run covers one of its ends
            if not (free[at] and free[at + low - 1]):
                continue
            there = places[what]
            while there and not (free[there[-1]] and free[there[-1] + low - 1]):
                there.pop()
            if there:
                free[at : at + low] = free[there[-1] : there[-1] + low] = False
                done += low
        most = low - 1
    return done


def covered(a: list[str], b: list[str]) -> int:
    """tiles(), found another way where comparing all places would take too long."""
    if a == b:
        return len(a)
    return tiles(a, b, 2) if len(a) * len(b) <= 250_000 else long_tiles(a, b, 2)


def covered_at_most(a: list[str], b: list[str]) -> int:
    """The words of a in runs of two that b has: no tiling covers more."""
    pairs, marked = set(zip(b, b[1:])), [False] * len(a)
    for i, pair in enumerate(zip(a, a[1:])):
        if pair in pairs:
            marked[i] = marked[i + 1] = True
    return sum(marked)


_LEAD = re.compile(r"^\W*(?:\w+\W+){0,6}?(?:\w+['’]?\w*)?\s*[:,\-–]\s*|^\W*(?:your question was|you asked|the question is|regarding|question|query|q)\b\W*", re.I)


LEAD_WORDS = 10  # a lead has fewer


def is_copy(question: str, answer: str) -> bool:
    """Nearly all of the answer, but for a short lead, is tiled by the question, and most of the question by the answer. The
    question may be given several times over."""
    q, a = _terms(question), _terms(answer)
    if not q or not a:
        return False
    once = Counter(q)
    if sum(map(once.__contains__, a)) < 0.85 * (len(a) - LEAD_WORDS):
        return False  # whatever the lead, too many words are not the question's
    for body in (a, _terms(_LEAD.sub("", answer, count=1))):
        if len(body) < 2 or len(body) < 0.4 * len(q):
            if body != q:
                continue
        n = max(1, round(len(body) / len(q)))
        # runs first, then single words that were moved
        bag = sum(min(c, n * once[w]) for w, c in Counter(body).items())
        if bag >= 0.85 * len(body) and bag >= 0.5 * n * len(q) and covered_at_most(body, q * n) >= 0.6 * len(body) and covered(body, q * n) >= 0.6 * len(body):
            return True
    return False


# ---- refusal -------------------------------------------------------------------------------------------------------------

_ACT = r"(?:answer\w*|respon[ds]\w*|reply\w*|comment\w*|assist\w*|help\w*|discuss\w*|address\w*|provid\w*|produc\w*|shar\w*|cover\w*|generat\w*|offer\w*|complet\w*|fulfil\w*|pass|decline|disclos\w*|speak|talk|opin\w*|advis\w*|advice)"
_CANNOT = r"(?:cannot|can ?not|can't|could ?n[o']t|couldn't|won't|will not|must(?: respectfully)? decline|have to (?:pass|decline)|decline|am (?:not (?:able|allowed|permitted|authori[sz]ed|in a position|at liberty)|unable)|was (?:not able|unable)|'m (?:not (?:able|allowed|permitted)|unable)|(?:do not|don't|lack) (?:have )?(?:\w+ )?(?:enough|sufficient|the)?|am unable)"
# agent, inability and act in general: an assistant that speaks of itself, what it may not do, and dealing with what was asked
_AGENT = r"(?:this|the|your|an?) (?:\w+ )?(?:assistant|chatbot|bot|language model|ai|ai model|ai system)"
_INABLE = r"(?:cannot|can ?not|can't|won't|will not|must not|may not|shall not|declines?|refuses?|(?:is|am|are|was|has been)(?: not|n't) (?:\w+ )?(?:permitted|allowed|able|authori[sz]ed|in a position|at liberty|designed|equipped|programmed|intended|meant)|(?:is|am|are|was) (?:unable|forbidden|prohibited|barred|prevented))"
_DEAL = r"(?:(?:deal(?:ing)?|engag\w+|proceed\w*|help\w*|go on|continue) (?:with|on|further)|handl\w+|tak\w+ (?:on|up)|process|fulfil\w*|honou?r|compl(?:y|ies)|carry out|satisfy|respon\w+|entertain\w*) (?:\w+ ){0,3}?(?:request|question|query|enquiry|inquiry|prompt|demand|matter|topic|subject|this|that|it)"
REFUSALS = {
    "en": [
        rf"\bi(?: |')(?:\w+ )?{_CANNOT}\b[^.]*\b{_ACT}\b",
        r"\bi (?:have to|must|will|shall) pass\b",
        r"\bi (?:do not|don't) have (?:enough|sufficient|any)\b[^.]*\b(?:information|context|evidence|data)\b",
        rf"\bnot (?:something|a (?:question|topic)) (?:that )?i (?:can|may|am)\b",
        rf"\bsomething (?:that )?i (?:won't|cannot|can't|will not|may not|am not able to)\b[^.]*\b{_ACT}\b",
        r"\b(?:lies|falls|is|goes) (?:outside|beyond)\b[^.]*\b(?:i|me|my)\b",
        rf"\b{_ACT} (?:this |that |it )?(?:would|will) (?:go beyond|violate|breach|exceed|not be)\b",
        r"\bmy (?:guidelines|policy|policies|instructions|rules|training|programming)\b[^.]*\b(?:prevent|forbid|prohibit|bar|(?:do|does) ?n[o']t (?:allow|permit|let)|stop|keep)\w*",
        r"\b(?:evidence|information|context|passages?|filings?|documents?|material)\b[^.]*\b(?:does|do)(?: not|n't) (?:allow|permit|let|support)\b[^.]*\b(?:me|answer|response)\b",
        r"\bnothing in\b[^.]*\b(?:lets|allows|permits|enables) me\b",
        rf"\bwould not be (?:appropriate|right|proper)\b[^.]*\b(?:me|{_ACT})\b",
        rf"\bno (?:answer|response|reply|comment)\b[^.]*\b(?:can|could|may|will) be (?:given|provided|made|offered)\b",
        rf"\bit is not possible\b[^.]*\b{_ACT}\b",
        rf"\b{_AGENT}\b[^.]*\b{_INABLE}\b[^.]*\b(?:{_ACT}|{_DEAL})\b",
        rf"\b(?:i|{_AGENT}) (?:\w+ )?{_INABLE}\b[^.]*\b{_DEAL}\b",
    ],
    "de": [
        r"\b(?:kann|darf|könnte|möchte|werde) (?:ich|wir) [^.]*\b(?:nicht|keine?n?)\b[^.]*\b(?:beantworten|antworten|helfen|kommentieren|äußern|auskunft|unterstützen|sagen|geben|behilflich)\b",
        r"\bich (?:kann|darf|möchte|werde) [^.]*\b(?:nicht|keine?n?)\b[^.]*\b(?:beantworten|antworten|helfen|kommentieren|äußern|auskunft|unterstützen|sagen|geben|behilflich|dienen)\b",
        r"\b(?:kann|darf) ich nicht (?:helfen|beantworten|kommentieren)\b",
        r"\b(?:ist|war) (?:es )?mir (?:leider )?nicht (?:möglich|gestattet|erlaubt)\b",
        r"\bich (?:bin|habe) [^.]*\bnicht (?:befugt|berechtigt|in der lage|genügend|genug)\b",
        r"\bkeine antwort\b[^.]*\b(?:möglich|geben|gegeben)\b",
    ],
    "fr": [
        r"\bje (?:ne )?(?:peux|puis|suis|saurais|dispose|veux|souhaite)\b[^.]*\b(?:pas|point)\b[^.]*\b(?:répondre|commenter|aider|réponse|autorisée?|mesure|fournir|assez|discuter|assister)\b",
        r"\bje ne suis pas (?:autorisée?|en mesure|habilitée?)\b",
        r"\bil (?:m'|m’)(?:est|était) impossible\b",
        r"\baucune réponse\b[^.]*\b(?:donnée|possible|fournie)\b",
        r"\bje (?:dois|préfère) (?:décliner|refuser|m'abstenir)\b",
    ],
    "es": [
        r"\bno (?:puedo|podré|podría|quiero|debo)\b[^.]*\b(?:responder|contestar|ayudar\w*|comentar|respuesta|proporcionar|ofrecer|asistir\w*|hablar)\b",
        r"\bno (?:me )?(?:es|resulta|fue) posible\b[^.]*\b(?:responder|contestar|ayudar\w*|comentar|atender\w*|proporcionar)\b",
        r"\bno (?:estoy|me encuentro) (?:autorizad[oa]|en condiciones|facultad[oa])\b",
        r"\bno (?:dispongo|tengo)\b[^.]*\b(?:información|permitid[oa]|datos)\b",
        r"\bno se puede dar (?:una |ninguna )?respuesta\b",
        r"\bdebo (?:declinar|rechazar)\b",
    ],
}
COURTESIES = [
    r"thank you\b.*", r"thanks\b.*", r"(?:hello|hi|dear|good (?:morning|day))\b.{0,60}", r".*\bconsult (?:a|an|your|with)\b.*", r".*\brephrase (?:your|the) question\b.*", r".*\banything else\b.*", r".*\basking about (?:another|a different)\b.*",
    r"(?:please )?(?:contact|refer to|see|visit|ask)\b.*", r".*\bdirectly", r"(?:unfortunately|regrettably|apologies|i apologi[sz]e|sorry|i'm sorry|i am sorry|leider|entschuldigung|es tut mir leid|lo siento|lo lamento|désolée?|je suis désolée?|malheureusement|lamentablemente|desafortunadamente)\b.{0,20}",
    r"let me be clear", r"i (?:appreciate|understand) .{0,40}", r"(?:bitte|danke|vielen dank|gracias|merci|por favor|veuillez|s'il vous plaît)\b.*", r"is there .*", r"(?:you may|try|feel free|i(?:'d| would) be happy|i hope|let me know)\b.*", r".*\bno supporting passages\b.*",
]
# each pattern as its parts around the gaps, which are runs without a full stop
_REFUSE = [[re.compile(x, re.I) for x in p.split("[^.]*")] for ps in REFUSALS.values() for p in ps]
# without one of these words no pattern above can match
_NEGATION = re.compile(r"n[o']t\b|\b(?:no|nothing|pass|unable|lack|outside|beyond|violate|breach|exceed|nicht|keine?n?|pas|point|impossible|aucune|dois|préfère|debo)\b|\b(?:declin|refus|prevent|forbid|prohibit|bar|stop|keep)", re.I)
_COURTESY = [re.compile(r"\W*+" + p + r"\W*", re.I | re.S) for p in COURTESIES]
_SENTENCE = re.compile(r"(?<=[.!?])[\"”»')\]]*\s+(?=[A-ZÀ-Þ¿¡\"“«(\[*#|-])|\n+")


def _in_order(parts: list[re.Pattern], run: str) -> bool:
    """What the parts match with any gaps between them, in linear time: each part, from the last, takes its latest place before
    the place of the next."""
    end = len(run)
    for part in reversed(parts[1:]):
        at, m = -1, part.search(run, 0, end)
        while m:
            at = m.start()
            m = part.search(run, at + 1, end)
        if at < 0:
            return False
        end = at
    return parts[0].search(run, 0, end) is not None


def _refuses(sentence: str) -> bool:
    runs = sentence.split(".")
    return any(_in_order(parts, run) for parts in _REFUSE for run in runs)


def _sentences(text: str) -> Iterator[str]:
    at = 0
    for m in _SENTENCE.finditer(text):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


def is_refusal(answer: str) -> bool:
    """At least one refusing sentence, and all others are courtesies: what answers anything besides is no refusal."""
    t = visible(answer).replace("’", "'")
    refused = 0
    for s in _sentences(t):
        s = s.strip(" *_#>-\"'“”«»")
        if not any(c.isalnum() for c in s):
            continue
        if _NEGATION.search(s) and _refuses(s):
            refused += 1
        elif not any(c.fullmatch(s) for c in _COURTESY) and len(_terms(s)) > 2:
            return False
    return refused > 0


# ---- language ------------------------------------------------------------------------------------------------------------

_QUOTED = re.compile(r"«[^»]*»|“[^”]*”|„[^“”]*[“”]|\"[^\"\n]*\"|\[[^\]\n]*\]|\(source:[^)]*\)", re.I)
# More words of the four languages that are frequent in answers about filings.
MORE_WORDS = {
    "en": "our we its into from over than could should would been did does what which how why about these those per due net after before since through",
    "de": "wie welche warum über unter seit vom beim ihre seine keine mehr noch damit dass wenn gegenüber vergleich jahr außerdem zudem obwohl während wesentlichen deutlich könnte neuen stieg ging wenigen ab unser",
    "fr": "comment quel quels quelle pourquoi chez après malgré depuis leur nos notre ses cette entre sous dont hausse société bien que avant résume quelles cite pourrait nouvelles jusqu moins quelques marge",
    "es": "cómo qué cuál por qué durante según nuestro nuestra sus muy sin mediante aunque mientras menos anterior sobre empresa resume qué riesgos frente dirección filial segmento podría nuevas normas hasta pese pocos cartera gasto margen",
}
_WEIGHT: dict[str, list[tuple[int, float]]] = {}
for _words in (FUNCTION_WORDS, MORE_WORDS):
    _of: dict[str, list[int]] = {}
    for _k, _l in enumerate(LANGS):
        for _w in set(_words[_l].split()):
            _of.setdefault(_w, []).append(_k)
    for _w, _ks in _of.items():
        _WEIGHT.setdefault(_w, []).extend((_k, 1 / len(_ks)) for _k in _ks)
_LETTERS = [re.compile(r"(?!)"), re.compile("[äöüß]", re.I), re.compile("[èêëàâîïôùûçœ]|\\b[ldsnjqcm]['’](?=\\w)", re.I), re.compile("[ñóíáú¿¡]", re.I)]


def votes(text: str) -> list[float]:
    t = text.lower()
    v = [0.0] * len(LANGS)
    for w in re.findall(r"[^\W\d_]+", t):
        for k, x in _WEIGHT.get(w, ()):
            v[k] += x
    if t.isascii():  # only elisions remain of the letters that tell languages apart
        v[2] += 0.5 * len(_LETTERS[2].findall(t)) if "'" in t else 0.0
        return v
    return [x + 0.5 * len(p.findall(t)) for x, p in zip(v, _LETTERS)]


_SHORT_LEAD = re.compile(r"^\W*(?:[^\W\d_]+\s+){0,4}[^\W\d_]+:\s+(?=\S)")


_OTHER_SCRIPT = re.compile("[ɐ-᷿ἀ-\U0010ffff]")


def _script(text: str) -> str:
    """Latin, or the block of another script that most letters belong to."""
    if text.isascii() or not _OTHER_SCRIPT.search(text):
        return "latin"
    n = Counter(hex(ord(c) >> 8) if _OTHER_SCRIPT.match(c) else "latin" for c in text if c.isalpha())
    return n.most_common(1)[0][0] if n else "latin"


def _echo_free(question: str, answer: str) -> str:
    q, a = visible(question), visible(answer)
    return a[len(q) :] if a.lower().startswith(q.lower()) else a


def is_foreign(question: str, answer: str) -> bool:
    """The body of the answer, without quotations, citations and a repeated question, is in another script or language."""
    body = _SHORT_LEAD.sub("", _QUOTED.sub(" ", _echo_free(question, answer)), count=1)
    if not any(c.isalpha() for c in body):
        return False
    if _script(body) != _script(question):
        return True
    vq, va = votes(_QUOTED.sub(" ", question)), votes(body)
    if not any(vq) or not any(va):
        return False
    q, a = vq.index(max(vq)), va.index(max(va))
    return q != a and va[a] >= 1.5 and va[a] >= 1.5 * va[q] + 0.5


# ---- truncated -----------------------------------------------------------------------------------------------------------

OPENERS, CLOSERS = "([{«“„", {")": "(", "]": "[", "}": "{", "»": "«", "”": "“„", "“": "„"}
_MARK = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^<>]*(/?)>|\*\*|__|[`\"()\[\]{}«»“”„]")
_FENCE = re.compile(r"^\s*(```+|~~~+)")


def open_constructs(text: str) -> list[str]:
    """The stack of what is still open at the end: fences, markup tags, brackets, quotations, emphasis and inline code.

    A fence hides what it holds. Emphasis and inline code end with their paragraph; a closing mark that nothing opened is text.
    """
    stack: list[str] = []
    fence = ""
    lines = text.split("\n")
    for at, line in enumerate(lines):
        m = _FENCE.match(line)
        if fence:
            if m and m[1][:3] == fence:
                fence = ""
                stack.remove("fence")
            continue
        if m:
            fence = m[1][:3]
            stack.append("fence")
            continue
        if not line.strip() and at < len(lines) - 1 and any(x.strip() for x in lines[at:]):
            stack = [s for s in stack if s not in ("**", "`", '"')]
        i = 0
        while m := _MARK.search(line, i):
            i, c = m.end(), m[0]
            if m[2]:
                name = "<" + m[2].lower()
                if m[1]:
                    if name in stack:
                        del stack[len(stack) - 1 - stack[::-1].index(name) :]
                elif not m[3] and name not in ("<br", "<hr", "<img", "<p", "<li", "<td", "<tr", "<th"):
                    stack.append(name)
            elif c == "**":
                _toggle(stack, "**")
            elif c == "__":
                at = m.start()
                if at and re.match(r"\w__\w", line[at - 1 : at + 3]):
                    i = at + 1  # inside a word
                else:
                    _toggle(stack, "**")
            elif c == "`":
                _toggle(stack, "`")
            elif c == '"':
                if '"' in stack or not (m.start() and line[m.start() - 1].isdigit()):
                    _toggle(stack, '"')
            elif c in CLOSERS and any(o in stack for o in CLOSERS[c]):
                o = next(o for o in reversed(stack) if o in CLOSERS[c])
                del stack[len(stack) - 1 - stack[::-1].index(o) :]
            elif c in OPENERS:
                stack.append(c)
    return stack


def _toggle(stack: list[str], mark: str) -> None:
    if mark in stack:
        del stack[len(stack) - 1 - stack[::-1].index(mark) :]
    else:
        stack.append(mark)


def table_breaks_off(lines: list[str]) -> bool:
    """Whether the table that the text ends with has an unfinished last row, or no row under its head."""
    rows = []
    for line in reversed(lines):
        if not line.strip().startswith("|"):
            break
        rows.append(line.strip())
    if not rows:
        return False
    rows.reverse()
    if not rows[-1].endswith("|") or len(rows[-1]) < 2:
        return True
    cells = rows[0].count("|")
    return rows[-1].count("|") != cells or bool(_TABLE_RULE.fullmatch(rows[-1])) or (len(rows) == 1 and len(lines) > 1)


# An answer that is only a value needs no sentence.
_VALUE = re.compile(r"(?:(?:yes|no|item \w+|part \w+|note \w+|q[1-4]_(?:19|20)\d\d|fy_?\d{4}|10-[kq]|[$€£]?\d[\d.,]*\s?%?|million|billion|mio\.?|m|mrd\.?|eur|usd|and|or|to|und|et|y|o|ou|oder|sí|si|oui|ja|nein|non|jan\w*|feb\w*|mar\w*|apr\w*|may|june?|july?|aug\w*|sep\w*|oct\w*|nov\w*|dec\w*)[\s.,;]*)+", re.I)
_TOKEN = re.compile(r"\n|\$?\d[\d.,]*\d%?|\$?\d%?|[^\W\d]+(?:[-'’&][^\W\d]+)*|[^\w\s]")
ENDS = {".", "!", "?", "\n"}
_UNSAID = set('"”»*_')  # marks that don't count between words
_seen: dict[str, tuple[str, str]] = {}


def _shape(w: str) -> tuple[str, str]:
    """A token as it counts at a line's start and elsewhere: names and numbers by their shape."""
    if w[0].isdigit() or w[0] == "$":
        x = "Y" if re.fullmatch(r"(?:19|20)\d\d", w) else re.sub(r"\d+", "9", w)
        return x, x
    if w[0].isalpha():
        return w.lower(), "X" if w[0].isupper() and len(w) > 1 and w[1:].islower() else w.lower()
    return w, w


def end_tokens(text: str, starts_line: bool = True) -> list[str]:
    """Words, marks and line breaks, with names and numbers by their shape."""
    out, mid = [], not starts_line
    if len(_seen) > 200_000:
        _seen.clear()
    for w in _TOKEN.findall(text):
        pair = _seen.get(w)
        if pair is None:
            pair = _seen[w] = _shape(w)
        out.append(pair[mid])
        mid = w != "\n"
    return out


def _tail(text: str, least: int = 8) -> list[str]:
    """The last end_tokens() of a text, at least so many that count, or all. Tokens don't reach over white space."""
    n = 300
    while n < len(text):
        cut = text.find(" ", len(text) - n)
        if cut >= 0:
            line = text.rfind("\n", 0, cut) + 1
            toks = end_tokens(text[cut:], not text[line:cut].strip())
            if sum(x not in _UNSAID and x not in ")]" for x in toks) >= least:
                return toks
        n *= 2
    return end_tokens(text)


def _id(w: str) -> int:
    return xxhash.xxh64_intdigest(w)


_TURN = np.uint64(0x9E3779B97F4A7C15)


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """A key for every k tokens in a row."""
    r = h[: max(0, len(h) - k + 1)].copy()
    for j in range(1, k):
        r = r * _TURN + h[j : j + len(r)]
    return mix(r + np.uint64(k)).view(np.int64)


def _key(parts: list[str]) -> int:
    return int(_runs(np.array([_id(w) for w in parts], np.uint64), len(parts))[0]) if parts else 0


def structure(answer: str) -> tuple[bool | None, int, int]:
    """(True: breaks off, False: whole, None: for the sentence ends of the corpus to tell; keys of the last three and two words)."""
    t = visible(answer)
    lines = [x for x in t.split("\n") if x.strip()]
    last = lines[-1].strip()
    if len(lines) == 1 and _VALUE.fullmatch(last) and not last.lower().endswith((" and", " or", " to", " und", " et", " y", " o", " ou", " oder")):
        return False, 0, 0
    if open_constructs(t):
        return True, 0, 0
    if last.startswith("|"):
        return table_breaks_off(lines), 0, 0
    if last.startswith(("```", "~~~")) or _TAG.search(last) and last.endswith(">"):
        return False, 0, 0
    if _BULLET.fullmatch(last + " ") or len(lines) > 1 and _HEADING.fullmatch(last):
        return True, 0, 0
    bare = re.sub(r"[\"”»)\]*_'’]+$", "", last).rstrip()
    if last.endswith(("...", "…")) or not bare or bare[-1] in ":,;-–—(/&$€+=":
        return not bare.endswith(("]", ")")) if bare else False, 0, 0
    toks = _tail(t)
    if bare[-1] in ".!?。！？":
        body = [x for x in toks if x not in _UNSAID and x not in ")]"]
        while body and body[-1] in ENDS:
            body.pop()
        if body and body[-1][0] in "9$" and "%" not in body[-1] and not last.rstrip('"”»*').endswith((")", "]")):
            return None, _key(body[-3:]), _key(body[-2:])  # a number may have been cut at its point
        return False, 0, 0
    if last[-1] in ")]»”\"" or len(toks) <= 5:
        if last[-1] in ")]":
            return False, 0, 0
    if _unlike_the_rest(lines):
        return True, 0, 0
    body = [x for x in toks if x not in _UNSAID]
    return None, _key(body[-3:]), _key(body[-2:])


def _unlike_the_rest(lines: list[str]) -> bool:
    """Whether the text closes its sentences with a mark, all but the last: list items among items, prose among prose."""
    last = lines[-1]
    if _BULLET.match(last):
        items = [x.rstrip('*_"”»)] ') for x in lines[:-1] if _BULLET.match(x)]
        marked = sum(x.endswith((".", "!", "?")) for x in items)
        return marked > 0 and 2 * marked > len(items)
    return bool(re.search(r"[^\W\d]{3,}[.!?][\"”»)\]]*(?:\s|$)", " ".join(x for x in lines if not _BULLET.match(x) and not x.lstrip().startswith("|"))))


class _Codes:
    """Small numbers for tokens, and what each of them is."""

    def __init__(self):
        self.of: dict[str, int] = {}
        self.ids: list[tuple[int, int]] = []
        self.marks: list[tuple[bool, bool, bool, bool]] = []  # a line break, an end, an end or a bracket, not said

    def __call__(self, w: str) -> int:
        c = self.of.get(w)
        if c is None:
            c = self.of[w] = len(self.ids)
            first, mid = _shape(w)
            self.ids.append((_id(first), _id(mid)))
            self.marks.append((w == "\n", w in ENDS, w in ENDS or w in "[(", w in _UNSAID))
        return c


def sentence_ends(answers: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often each run of two and three tokens stands before another, and how often at a sentence's end: keys, counts of
    both."""
    code, flat, n = _Codes(), [], []
    get = code.of.get
    for a in answers:
        toks = _TOKEN.findall(visible(a)) if a else []
        if len(toks) >= 3:
            flat.extend([c if (c := get(w)) is not None else code(w) for w in toks])
            n.append(len(toks))
    if not n:
        return (np.zeros(0, np.int64),) * 3
    flat, text = np.array(flat, np.int64), np.repeat(np.arange(len(n)), n)
    br, end, stop, unsaid = (np.array(x, bool)[flat] for x in zip(*code.marks))
    starts = np.concatenate([[True], br[:-1] | (text[1:] != text[:-1])])
    h = np.array(code.ids, np.uint64)[flat, np.where(starts, 0, 1)]
    h, end, stop, text = (x[~unsaid] for x in (h, end, stop, text))
    keys, ends = [], []
    for k in (2, 3):  # a run, and the token after it in the same text
        r = _runs(h, k)[:-1]
        ok = ~end[k - 1 : -1] & (text[k:] == text[: len(text) - k])
        keys.append(r[ok[: len(r)]]), ends.append(stop[k:][ok[: len(r)]])
    keys, ends = np.concatenate(keys), np.concatenate(ends)
    k, inv = np.unique(keys, return_inverse=True)
    return k, np.bincount(inv, minlength=len(k)), np.bincount(inv[ends], minlength=len(k))


def defect(question: str, answer: str | None) -> tuple[str | None, int, int]:
    """The defect of a pair, or None; "?" and the keys of the last words, where the corpus has to tell."""
    if answer is not None and is_copy(question, answer):
        return "copy", 0, 0
    if is_empty(answer):
        return "empty", 0, 0
    if is_refusal(answer):
        return "refusal", 0, 0
    if is_foreign(question, answer):
        return "language", 0, 0
    broken, k3, k2 = structure(answer)
    return ("truncated" if broken else None if broken is False else "?"), k3, k2


SALTS = 16
LEAST_END = 0.04


def broken_pairs(df: DataFrame, id_col: str = "id", question_col: str = "modif_query", answer_col: str = "llm_response_sec") -> DataFrame:
    """id, defect (empty, copy, refusal, language or truncated), one row for each defective id.

    Rows with a null id or a null or blank question are no pairs; a null answer is an empty one. Rows that repeat an id count
    once; if they differ, the defect that comes first in the alphabet counts. Sentence ends are counted over all answers, by
    partial aggregation. The few answers that they decide on are joined to them salted.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(question_col).alias("q"), F.col(answer_col).alias("a")).filter("id IS NOT NULL AND q IS NOT NULL")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = b.column(0), []
            for q, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                out.append(defect(q, a) if visible(q) else (None, 0, 0))
            keep = [i for i, x in enumerate(out) if x[0]]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array([out[i][0] for i in keep], pa.string()), *(pa.array([out[i][k] for i in keep], pa.int64()) for k in (1, 2))], ["id", "defect", "k3", "k2"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in sentence_ends(b.column(0).to_pylist())], ["k", "n", "e"])

    judged = staged(rows.mapInArrow(judge, "id string, defect string, k3 bigint, k2 bigint"), "pairs")
    open_ = judged.filter("defect = '?'").withColumn("salt", F.expr(f"pmod(xxhash64(id), {SALTS})"))
    asked = open_.select(F.explode(F.array("k3", "k2")).alias("k")).distinct()
    ends = rows.select("a").filter("a IS NOT NULL").mapInArrow(count, "k bigint, n bigint, e bigint").groupBy("k").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    ends = staged(ends.join(asked, "k", "left_semi").withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)"))), "pair-ends")
    three, two = (ends.select(F.col("k").alias(f"k{x}"), "salt", F.col("n").alias(f"n{x}"), F.col("e").alias(f"e{x}")) for x in (3, 2))
    told = open_.join(three, ["k3", "salt"], "left").join(two, ["k2", "salt"], "left")
    share = F.when(F.col("n3") >= 3, F.col("e3") / F.col("n3")).when(F.col("n2") >= 1, F.col("e2") / F.col("n2")).otherwise(0.0)
    cut = told.filter(share < LEAST_END).select("id", F.lit("truncated").alias("defect"))
    return judged.filter("defect <> '?'").select("id", "defect").unionByName(cut).groupBy("id").agg(F.min("defect").alias("defect"))
