import random

import numpy as np
import pytest

from dasymetra.llm import residue
from dasymetra.llm.residue import Laid, find, fit, judge
from dasymetra.llm.residue_seeds import FILLER, NOTICE

SUBJECTS = ["The clerk", "The old ferryman", "A câmara municipal", "O vigia noturno", "La jueza", "Le greffier", "Der Gemeinderat"]
ACTS = ["counted the empty chairs", "drew a new boundary line", "contou as cadeiras vazias", "perdeu a chave do arquivo", "leyó el acta", "a pesé chaque sac", "las das Protokoll laut vor"]
TIMES = ["at noon", "after the storm", "no fim da noite", "en la estación seca", "avant l'aube", "am Markttag"]
TALK = ["Her course in {} teaches JavaScript to {} pupils.", "The clerk noted that page 404 of the ledger in {} was not found after {} days.", "Access to the hall in {} was denied to {} late voters.", "He wrote [sic] beside {} and paid ${}0 for it.", "The set {{1, 2, 3}} of boxes from {} was opened by {}.", "Turnout in {} fell by {}% there."]
BAD = ["404 Not Found", "Please switch JavaScript back on. Then reload this page.", "Sua sessão expirou.", "Lorem ipsum donec quam felis ultricies nec pellentesque", "Your headline goes here.", "Texto provisório, inserir o seu texto depois", "Exception in thread \"main\" java.lang.NullPointerException at app.x.Handler7.run(Handler.java:75)", "ERRO INTERNO DO SERVIDOR (500)", "お探しのページはありません。"]
NAME = "Insert the full legal name of the contracting party here, as it stands in the register"
MARKS = ["{{ name }}", "%(city)s", "<nome>", "[[DATE]]", "${total}", "__count__", "[insert date here]", "???", "XX/XX/XXXX", "undefined", "#N/A", "{}", "%s"]


@pytest.fixture(scope="module")
def judged(spark):
    rnd = random.Random(2)
    place = lambda: rnd.choice(["Itó", "Caiçu", "Boitu", "Vére"]) + rnd.choice(["zal", "vão", "ró", "nema", "polis"])
    sentence = lambda: f"{rnd.choice(SUBJECTS)} {rnd.choice(ACTS)} {rnd.choice(TIMES)} in {place()}."
    rows, truth = [], set()
    for i in range(4000):
        text = " ".join(sentence() for _ in range(rnd.randint(1, 3)))
        x = rnd.random()
        if x < 0.04:
            text, _ = rnd.choice([(rnd.choice(BAD), 0), (f"{text} {rnd.choice(BAD)}", 0)]), truth.add(i)
        elif x < 0.08:
            text, _ = f"{rnd.choice(MARKS)} {rnd.choice(ACTS)} {rnd.choice(TIMES)}, said the paper from {place()}.", truth.add(i)
        elif x < 0.16:
            text = rnd.choice(TALK).format(place(), rnd.randint(20, 90))
        rows.append((i, text if isinstance(text, str) else text[0], "x"))
    rows += [(9001, None, "x"), (9002, "", None), (9003, "  ", "x"), (9004, "<p>The clerk counted the empty chairs at noon.</p>", "x"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, residue string").cache()
    models = fit(docs)
    out = find(docs, models, keep=["doc_id", "residue"])
    assert out.columns == ["doc_id", "residue", "residue_", "residue_share"]
    return {r.doc_id: r for r in out.collect()}, truth, models


def test_residue_is_found_and_talk_about_it_is_not(judged):
    out, truth, _ = judged
    found = {i for i, r in out.items() if r.residue_}
    assert len(found & truth) >= 0.97 * len(truth)
    assert len(found - truth) <= 0.02 * len(truth)


def test_empty_texts_are_clean(judged):
    out, _, _ = judged
    assert all(out[i].residue_ == [] and out[i].residue_share == 0 for i in (9001, 9002, 9003, 9004))


def test_no_phrase_of_these_tests_is_a_seed():
    seeds = [s.lower() for s in (*FILLER, *NOTICE)]
    assert not [b for b in BAD if any(s in b.lower() or b.lower() in s for s in seeds)]


def test_counts_and_probabilities():
    count = lambda texts, weights=None: (out := np.zeros(residue.BUCKETS), Laid(texts).pieces()[0].count(out, weights))[0]
    assert np.array_equal(count(["abc", "", "abd"]), count(["abc"]) + count(["abd"]))
    assert np.array_equal(count(["abc", "abd"], np.array([True, False])), count(["abc"]))
    table = np.stack([count(["abc", "abd"]), count(["xyz"])], axis=1).astype(np.float32)
    logs = Laid(["abc"]).pieces()[0].log_probabilities(table, np.array([6.0, 3.0]), [5, 5])
    assert logs.shape == (3, 2) and (logs <= 0).all() and (logs[:, 0] > logs[:, 1]).all() and logs[1, 0] > logs[2, 0]
    assert not count([""]).any() and len(Laid([""]).pieces()[0].place) == 0


@pytest.mark.parametrize("text, is_one", [(f"The clerk saw {m} after the storm in Itózal.", True) for m in MARKS] + [
    ("null perdeu a chave do arquivo at noon.", True), ("A jueza saw [USER] at noon.", True), ("The clerk counted <<QTD>> chairs.", True), ("Das las ~date~ protokoll.", True), ("%1$s drew a new line.", True),
    ("<%= x %> drew a new line.", True), ("The hall in {0:place} was full.", True), (f"Signed by [{NAME}] today.", True), (f"Signed by [[{NAME}]] today.", True), (f"Signed by <<{NAME}>> today.", True),
    (f"Signed by <% {NAME} %> today.", True), ("Signed by @@" + "A" * 90 + "@@ today.", True),
    ("He wrote [sic] beside Itózal and paid $60 for it.", False), ("<p>The clerk counted</p>", False), ("Turnout in Itózal fell by 12% there.", False), ("The set {1, 2, 3} of boxes from Itózal was opened by 9.", False),
    ("Who was it?!", False), ("(page 12)", False), ("Annan drew a new line.", False)])
def test_placeholders_by_the_model(judged, text, is_one):
    assert judge([text], judged[2], residue.Settings()).marked.tolist() == [is_one]


def test_pieces():
    def pieces(*texts):
        stream, owner = Laid(list(texts)).pieces()
        return [(int(o), stream.text(k)) for k, o in enumerate(owner)]

    assert pieces("Ref 9f2c7a1b0e 12 <p>X</p>") == [(0, "ref h 0"), (0, "x")]
    assert pieces("A b. C d!\n[2020] Portal X | E f", "", "  g") == [(0, "a b."), (0, "c d!"), (0, "portal x"), (0, "e f"), (2, "g")]
    assert pieces("a \0 b – c", "") == [(0, "a b"), (0, "c")]
    assert pieces(" ") == [] and pieces() == [] and pieces("/a/b c", "x\u200by") == [(0, "c"), (1, "xy")]


def test_a_long_text_is_judged_in_blocks_and_whole():
    text = "word " * 500_000
    parts = list(residue._blocks([None, "a", text, "b"]))
    whole = {}
    for places, part in parts:
        for i, t in zip(places.tolist(), part):
            whole[i] = whole.get(i, "") + t
    assert whole == {1: "a", 2: text, 3: "b"} and all(sum(map(len, part)) <= 2 * residue.BLOCK for _, part in parts)


def test_empty_table_and_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "The clerk counted the chairs. " * 20_000 + "404 Not Found")], "doc_id bigint, text string")
    models = fit(docs)
    assert [r.residue for r in find(docs, models).collect()] == [["notice"]]
    assert find(docs.limit(0), models).count() == 0 and find(docs.limit(0), fit(docs.limit(0))).count() == 0
