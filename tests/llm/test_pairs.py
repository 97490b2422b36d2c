import pytest

from quarrylens.llm import pairs as p

EN = "Which Hal Inc sections of 2004 mention the gross margin?"
FULL = "The gross margin was reduced by $1.2 million because of higher freight rates. It is expected to recover."
CASES = [
    *[(EN, a, "empty") for a in (None, "", " \n", "​", "n/a", "None.", "()", "<p></p>", "<br>", "```\n```", "## Analysis\n\n", "**Summary**\n\n- \n- ", "| Period | Value |\n|---|---|", "Answer:", "...", "--", "[ ]")],
    *[(EN, a, "copy") for a in (EN, EN.upper(), EN.lower().rstrip("?"), f'Your question was "{EN}"', f"Question: {EN}", "Which Hal Inc of sections 2004 mention the gross margin", "Which Hal Inc sections of mention the gross margin?", f"{EN} {EN}", f"# {EN}")],
    *[(EN, a, "refusal") for a in ("I cannot assist with questions about margins.", "Unfortunately, I have to pass on this one. Thank you for understanding.", "My guidelines prevent me from addressing this.", "Let me be clear: no answer can be given here.", "That lies outside the scope of what I can cover.", "I’m sorry, but I can’t help with that request.", "Apologies - the evidence supplied to me does not allow any answer.")],
    ("Wie hat sich die Marge bei BENO entwickelt?", "Es tut mir leid, bei der Marge kann ich nicht helfen.", "refusal"),
    ("Comment le stock a-t-il évolué ?", "Je ne suis pas autorisé à commenter BENO.", "refusal"),
    ("¿Por qué bajó la deuda en BENO?", "Lo siento, no puedo responder a esta pregunta.", "refusal"),
    *[(EN, a, "language") for a in ("La tasa impositiva creció menos que el año anterior, frente al trimestre anterior.", "Here is the summary: Der Vorstand stieg um 8,3 % auf 22,7 M EUR und hängt von wenigen Zulieferern ab.", "毛利率下降了百分之五。")],
    ("¿Por qué bajó la deuda en BENO?", FULL, "language"),
    *[(EN, a, "truncated") for a in (FULL + " However, management and", FULL + " Costs rose to $", FULL + "\n\n| Q | V |\n|---|---|\n| Q1 | $1 |\n| Q2 | $", FULL + "\n\n| Q | V |\n|---|---|\n| Q1 |", FULL + "\n\n**Outl", FULL + " The main drivers were:", FULL + " Short-term deb...", FULL + ' As one note puts it, "costs rose', FULL + "\n\n- ", FULL + " [10-Q, Q2_20", "```python\nx = 1", FULL + "\n\n## Outlook")],
    *[(EN, a, None) for a in (FULL, "Yes", "12.0%", "$1.2 million.", "Item 1A and Item 7", "Q4_2012 and Q2_2004", f"{EN}\n\n{FULL}", FULL + "\n\n| Q | V |\n|---|---|\n| Q1 | $1 |", FULL + " [10-Q, Q2_2012, Hal Inc, Risk Factors]", "Management declined to give guidance. " + FULL, "I'm sorry to note that Hal left out one quarter, so the figures below cover the rest. " + FULL, FULL + ' As one note puts it, "Costs rose."', "Locally this is known as «ingresos netos». " + FULL, "We are unable to estimate the loss, the filing adds. " + FULL, "```\nx = (1\n```")],
    ("Wie hat sich die Marge entwickelt?", "Die Marge stieg um 5 % auf 3,1 M EUR, und die Kosten sind nicht gestiegen.", None),
]


@pytest.mark.parametrize(("question", "answer", "want"), CASES)
def test_defects(question, answer, want):
    assert p.defect(question, answer)[0] == want


def test_tiles_against_brute_force():
    a, b = "the cat sat on the mat".split(), "on the mat the cat sat".split()
    assert p.tiles(a, b) == 6 and p.tiles(a, "mat on sat cat the".split()) == 0 and p.tiles([], b) == 0
    assert p.tiles("x y x y x y".split(), "x y".split()) == 2  # a tile is used once


def test_long_tiles_are_the_tiles():
    import random

    r = random.Random(2)
    for _ in range(600):
        v = [f"w{i}" for i in range(r.choice([1, 2, 3, 8, 30]))]
        a, b = ([r.choice(v) for _ in range(r.randint(0, 40))] for _ in "ab")
        assert p.long_tiles(a, b) == p.tiles(a, b) <= (len(a) if a == b else p.covered_at_most(a, b)), (a, b)
    v = [f"w{i}" for i in range(40)]
    a, b = ([r.choice(v) for _ in range(600)] for _ in "ab")
    assert p.covered(a, b) == p.tiles(a, b) < p.covered_at_most(a, b)  # long ones are tiled too


def test_long_copies_take_linear_time():
    q = "which part of the long question is it " * 4000
    assert p.is_copy(q, q) and p.is_copy(q, "Question: " + q.upper()) and not p.is_copy(q, " ".join(reversed(q.split()))) and not p.is_copy(q, "other words " * 9000)


@pytest.mark.parametrize("n", [2, 4, 7, 40])
def test_a_question_given_any_number_of_times(n):
    q = "Which Hal Inc sections of 2004 mention the gross margin and the tax rate, please?"
    assert p.is_copy(q, " ".join([q] * n)) and p.is_copy(q, "Your question: " + " ".join([q] * n)) and not p.is_copy(q, " ".join([FULL] * n))


def test_long_refusals():
    assert p.is_refusal("I cannot assist with questions about margins. Thank you for understanding. " * 40)
    assert not p.is_refusal("I cannot assist with questions about margins. " * 40 + FULL)
    assert not p.is_refusal("The information does not allow " * 20_000)  # in linear time


@pytest.mark.parametrize("said", ["This assistant is not permitted to deal with the request.", "The assistant is unable to process that query.", "An AI system cannot engage with this topic.", "I am prohibited from handling this matter.", "Your AI assistant declines to comment on margins."])
def test_refusals_by_agent_inability_and_act(said):
    assert p.defect(EN, said)[0] == "refusal" and p.defect(EN, said + " " + FULL)[0] is None


def test_sentence_ends_against_plain_counts():
    texts = [FULL, None, "", "a b. c", "one two\nthree (four) five", FULL + " And so on"]
    n, e = {}, {}
    for t in texts:
        toks = [x for x in p.end_tokens(p.visible(t)) if x not in p._UNSAID] if t else []
        for i in range(1, len(toks) - 1):
            for k in (2, 3):
                if toks[i] not in p.ENDS and i + 1 >= k:
                    key = p._key(toks[i + 1 - k : i + 1])
                    n[key], e[key] = n.get(key, 0) + 1, e.get(key, 0) + (toks[i + 1] in p.ENDS or toks[i + 1] in "[(")
    keys, all_, ends = p.sentence_ends(texts)
    assert dict(zip(keys.tolist(), all_.tolist())) == n and dict(zip(keys.tolist(), ends.tolist())) == e


def test_refusing_sentences_are_those_of_the_whole_patterns():
    import random
    import re

    whole = [re.compile(x, re.I) for ps in p.REFUSALS.values() for x in ps]
    words = "i cannot will not have enough answer information context does allow me my guidelines prevent . ich kann nicht beantworten je ne peux pas répondre no puedo responder keine antwort geben lies outside do provide not".split()
    r = random.Random(1)
    told = [" ".join(r.choices(words, k=r.randint(2, 14))) for _ in range(20_000)]
    said = [(any(x.search(t) for x in whole), bool(p._NEGATION.search(t)) and p._refuses(t)) for t in told]
    assert all(a == b for a, b in said) and 0 < sum(a for a, _ in said) < len(said)


def test_stack():
    assert p.open_constructs("a (b [c] d") == ["("] and p.open_constructs("1) one\n2) two") == [] and p.open_constructs('5" pipe') == []
    assert p.open_constructs("```\n(\n```\n") == [] and p.open_constructs("<div><b>x</b>") == ["<div"] and p.open_constructs("**a\n\nb") == []


def test_ends_of_the_corpus_decide(spark):
    whole = [(f"w{i}", "What changed?", "Key points\n\n" + "\n".join([f"- Costs rose by {i} million because of higher freight rates", "- Margins fell in line with guidance"][:: 1 if i % 2 else -1]), "x") for i in range(8)]
    cut = [("cut", "What changed?", "Key points\n\n- Costs rose by 3 million because of higher\n- Margins fell in line", "x")]
    df = spark.createDataFrame(whole + cut, "id string, modif_query string, llm_response_sec string, defect string")
    assert {(r.id, r.defect) for r in p.broken_pairs(df).collect()} == {("cut", "truncated")}


def test_nulls_repeats_and_long_texts(spark):
    rows = [(None, "q?", ""), ("a", None, ""), ("b", " ​", ""), ("c", "What is it?", None), ("c", "What is it?", None), ("d", "What is it?", "word " * 40_000 + "end."), ("e", "What is it?", "(" * 3000)]
    df = spark.createDataFrame(rows, "id string, modif_query string, llm_response_sec string")
    assert {(r.id, r.defect) for r in p.broken_pairs(df).collect()} == {("c", "empty"), ("e", "empty")}
    assert p.broken_pairs(df.filter("false")).count() == 0
