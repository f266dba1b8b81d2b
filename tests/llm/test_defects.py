import heldout_pairs as pairs
import pytest
from compare import rows

from memq.llm import defects
from memq.llm.defects import defect

Q = "What is the monthly budget of Zogi Mubaba?"
FR = "Quel est le budget mensuel de Zogi Mubaba ?"


@pytest.mark.parametrize("answer", [None, "", "  \n", "?!", "- …", "👍"])
def test_empty(answer):
    assert defect(Q, answer) == "empty"


@pytest.mark.parametrize(
    "answer",
    [Q, Q.upper(), Q[:-1], f"> {Q}", f'"{Q}"', f"**{Q[:-1]}**", f"Q: {Q}", f"{Q}\n{Q}", "What is the monthly budget for Zogi Mubaba?", "What is the budget of Zogi Mubaba?", "  What  is the monthly budget of zogi_mubaba"],
)
def test_copied(answer):
    assert defect(Q, answer) == "copied"


@pytest.mark.parametrize(
    "answer",
    ["I'm sorry, but I'd rather not guess about this. Could you give me more details?", "As an assistant, that is something I must decline to answer.", "NOT IN MEMORY", "not_in_memory.", "I don't know.", "My notes do not cover this question.", "I cannot answer this question."],
)
def test_refusal(answer):
    assert defect(Q, answer) == "refusal"


@pytest.mark.parametrize(
    ("question", "answer"),
    [(FR, "Pour être franc, je ne peux pas répondre à cette question, demande-moi autre chose."), ("Wo wohnt Ada jetzt?", "Leider gilt: dazu kann ich nichts sagen; frag mich bitte etwas anderes."), ("¿Dónde vive Ada en este momento?", "Lo siento, pero me resulta imposible saberlo.")],
)
def test_refusal_in_the_language_of_the_question(question, answer):
    assert defect(question, answer) == "refusal"


@pytest.mark.parametrize(
    "answer",
    ["Secondo l'ultima sessione, adesso è 12 crowns e non più quello di prima.", "Nach den Notizen aus Baza lautet die Antwort so: 12 crowns.", "De acordo com a última sessão, agora é 12 crowns e não o que foi dito antes.", "Según las notas de Baza, la respuesta es la siguiente: 12 crowns."],
)
def test_other_language(answer):
    assert defect(Q, answer) == "other_language"
    assert defect(None, answer) is None


@pytest.mark.parametrize(
    "answer",
    ["As of the latest session it is 12 crowns. You brought it up again when Tonal visited", "It is 12 crowns; the earlier value from your ch", "Two sessions mention this, and both give 12 crowns. I also found a mention of it:\n1.", f"{Q} You told me about it, and that repl"],
)
def test_truncated(answer):
    assert defect(Q, answer) == "truncated"


@pytest.mark.parametrize(
    "answer",
    [
        "537.90 crowns", "12", "Yes.", "- 12 crowns\n- Baza\n- Tuli", "street: Kadu Lane 19; city: Baza; floor: 8", "Nugevonburg, Pelevarville", "It is 12 crowns.", f"{Q} It is 12 crowns.",
        "I'm sorry to hear about the trip to Baza, but yes, the current value is 12 crowns.", "You were unable to confirm it in Robo; later you wrote that it is 12 crowns.",
        "Gazivur declined to help with it, yet the session in Feka states that it is 12 crowns.", 'Your note reads "12 crowns", which you repeated.', "night train via Baza", "Your budget is 12 crowns…",
    ],
)
def test_sound(answer):
    assert defect(Q, answer) is None


def heldout(kind):
    if kind == "refusal":
        return [(q, x) for lang, text in pairs.REFUSALS.items() for i, x in enumerate(pairs.lines(text)) for q in [pairs.QUESTIONS[lang][i % 2]]]
    if kind == "other_language":
        return [(pairs.QUESTIONS["en"][0], x[3:]) for x in pairs.lines(pairs.FOREIGN)]
    if kind == "truncated":
        own = {"Sie": "de", "Elle": "fr", "Ella": "es"}
        return [(pairs.QUESTIONS[own.get(x.split()[0], "en")][0], x) for x in pairs.lines(pairs.CUT)]
    return [(pairs.QUESTIONS["en"][0], x) for x in pairs.lines(pairs.ECHOED if kind == "copied" else pairs.SOUND)]


@pytest.mark.parametrize(("kind", "least"), [("refusal", 0.9), ("other_language", 0.9), ("truncated", 0.9), ("copied", 0.8), (None, 0.95)])
def test_wording_that_the_lists_were_not_written_from(kind, least):
    """Recall of each defect, and how many sound values pass; the pairs were written without looking at the tables."""
    data = heldout(kind)
    assert sum(defect(q, a) == kind for q, a in data) >= least * len(data)


def test_precision_on_the_same_pairs():
    kinds = ("refusal", "other_language", "truncated", "copied", None)
    found = [(kind, defect(q, a)) for kind in kinds for q, a in heldout(kind)]
    for kind in kinds[:-1]:
        given = [true for true, said in found if said == kind]
        assert sum(true == kind for true in given) >= 0.9 * len(given)


@pytest.mark.parametrize("lang", ["de", "fr", "es"])
def test_own_language_is_not_foreign(lang):
    """Answers in the language of the question, from the same list, are sound."""
    own = [x[3:] for x in pairs.lines(pairs.FOREIGN) if x.startswith(lang)]
    assert [defect(pairs.QUESTIONS[lang][0], x) for x in own] == [None] * len(own)


def test_lcs_against_the_table_method():
    import random

    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert defects.lcs(a, b) == t[-1][-1]


def test_frame(spark):
    data = [(1, Q, None, " Answered\t", "x"), (2, Q, None, "absent", "x"), (3, Q, "12", "answered", "x"), (4, None, None, "ANSWERED", "x"), (5, Q, Q, None, "x"), (6, Q, Q, "answered", "x"), (6, Q, Q, "answered", "x"), (7, Q, "word " * 50_000 + "of the", "answered", "x")]
    df = spark.createDataFrame(data, "line_no bigint, question string, answer string, status string, defect string")
    assert rows(defects.defective(df)) == {"('empty', 1)": 1, "('empty', 4)": 1, "('copied', 6)": 2, "('truncated', 7)": 1}
    assert defects.defective(df.limit(0)).count() == 0
