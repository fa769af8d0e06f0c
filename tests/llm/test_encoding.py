import random

import numpy as np
import pytest

from dasymetra.llm.encoding import LOST, WILD, Chain, Grams, Model, chains, distinct_names, fit, forms, garbled_names, repair

WORDS = "SÃO JOSÉ CONCEIÇÃO ÁGUA PARAÍSO ESTAÇÃO RIBEIRÃO CÓRREGO LAGOA VILA NOVA PORTO ITÓPOLIS ÍNDIOS BULHÕES ANTÔNIO JURÊ CATÃ DOURO MIRIM".split()


def _garble(text, written, read, twice=False):
    for _ in range(2 if twice else 1):
        text = text.encode(written).decode(read, errors="replace") if read != "cp1252" else "".join(bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in text.encode(written))
    return text


CASES = {
    "cp1252": lambda t: _garble(t, "utf_8", "cp1252"), "latin": lambda t: _garble(t, "utf_8", "latin_1"), "twice": lambda t: _garble(t, "utf_8", "cp1252", True), "mac": lambda t: _garble(t, "utf_8", "mac_roman"),
    "dos": lambda t: _garble(t, "utf_8", "cp850"), "dos1": lambda t: _garble(t, "cp1252", "cp850"), "mac1": lambda t: _garble(t, "cp1252", "mac_roman"), "cyrillic": lambda t: _garble(t, "cp1252", "cp1251"),
    "lost": lambda t: t.encode("latin_1").decode("utf_8", errors="replace"), "lower": lambda t: _garble(t, "utf_8", "cp1252").lower(), "half": lambda t: " ".join(_garble(w, "utf_8", "cp1252") if i else w for i, w in enumerate(t.split(" "))),
}


@pytest.fixture(scope="module")
def judged(spark):
    rnd = random.Random(4)
    rows, truth = [], {}
    for i in range(6000):
        name = " ".join(rnd.sample(WORDS, rnd.randint(1, 3)))
        kind = rnd.choice([*CASES]) if rnd.random() < 0.06 else "clean"
        shown = name if kind == "clean" else CASES[kind](name)
        if kind == "clean":
            shown = rnd.choice([shown, shown, shown, shown.title(), shown.lower(), f" {shown} ", shown.encode("ascii", "ignore").decode()])
        if shown != name and shown.lower() != name.lower() and kind != "clean":
            truth[str(i)] = (name, kind)
        rows.append((str(i), "a" if i % 3 else "b", shown))
    rows += [("n1", "a", None), ("n2", None, "SÃO"), ("n3", "a", ""), ("n4", "a", "  "), ("n5", "a", "DR. Nº 1 – 2ª")] + [rows[k] for k in range(30)]
    table = spark.createDataFrame(rows, "key string, place string, name string")
    return [r for r in repair(table, "place", "key", "name").collect()], truth


def test_garbled_names_are_found_and_clean_ones_are_not(judged):
    out, truth = judged
    found = {r.rec_key for r in out}
    assert len(found & truth.keys()) >= 0.99 * len(truth)
    assert len(found - truth.keys()) <= 0.01 * len(truth)
    assert min(r.posterior for r in out) >= 0.5


def test_lost_letters_are_found_by_posterior_alone(spark):
    rows = [(str(i), "a", w) for i, w in enumerate(["JOSÉ", "CONCEIÇÃO", "PARAÍSO", "ÁGUA"] * 300)] + [("x1", "a", "CONCEI��O"), ("x2", "a", "PARA?SO"), ("x3", "a", "JOS\x89"), ("x4", "a", "ÁGUA?"), ("x5", "a", "Ã�GUA")]
    table = spark.createDataFrame(rows, "key string, place string, name string")
    names = distinct_names(table, "place", "name")
    model = fit(names)
    out = {r.text: r for r in garbled_names(names, model).collect()}
    assert {t: r.restored for t, r in out.items()} == {"CONCEI��O": "CONCEIÇÃO", "PARA?SO": "PARAÍSO", "JOS\x89": "JOSÉ", "Ã�GUA": "ÁGUA"}
    for t, r in out.items():
        here = model.readings([t])[0]
        assert r.posterior == 1 - model.posteriors("a", "", here)[0] >= 0.5 and forms(t.split(" ")[0])


def test_two_lost_letters_are_filled_exactly():
    model = Model(np.zeros(2 * (1 << 19) + 1), {})
    Grams(["conceição", "paraíso", "índios"]).count(model.counts, np.ones(3))
    token = f"concei{WILD}{WILD}o"
    best = max((token.replace(WILD, a, 1).replace(WILD, b, 1) for a in "çãíé" for b in "çãíé"), key=lambda t: model.scores([t])[0])
    assert model.filled(token) == best == "conceição"


def test_source_and_place_have_priors_of_their_own(spark):
    rows = [(str(i), "a", "good", w) for i, w in enumerate(["JOSÉ", "SÃO", "ÁGUA"] * 200)] + [("b" + str(i), "a", "bad", CASES["cp1252"](w)) for i, w in enumerate(["JOSÉ", "SÃO", "ÁGUA"] * 20)]
    table = spark.createDataFrame(rows, "key string, place string, source string, name string")
    out = repair(table, "place", "key", "name", "source").collect()
    assert {r.source for r in out} == {"bad"} and len(out) == 60


def test_names_are_restored(judged):
    out, truth = judged
    whole = [(r.restored, truth[r.rec_key]) for r in out if r.rec_key in truth and truth[r.rec_key][1] != "lost"]
    assert sum((a or "").lower() == b.lower() for a, (b, _) in whole) >= 0.97 * len(whole)
    lost = [(r.restored, truth[r.rec_key][0]) for r in out if r.rec_key in truth and truth[r.rec_key][1] == "lost"]
    assert sum(a == b for a, b in lost) >= 0.8 * len(lost)


def test_every_chain_undoes_what_it_does():
    for name, read in (("utf_8>cp1252", "cp1252"), ("utf_8>latin_1", "latin_1")):
        chain = next(c for c in chains() if c.name == name)
        assert chain.options(_garble("CONCEIÇÃO", "utf_8", read))[0] == "CONCEIÇÃO"
    assert Chain("none").options("x") == []


def test_sure_signs_and_empty_tables(spark):
    assert LOST.search("S�O") and LOST.search("Ã\x83") and LOST.search("S?O") and not LOST.search("SÃO – 2ª?")
    assert repair(spark.createDataFrame([], "key string, place string, name string"), "place", "key", "name").count() == 0
    long = "SÃO JOSÉ " * 20_000
    rows = [("1", "a", long), ("2", "a", CASES["cp1252"](long))]
    assert [r.rec_key for r in repair(spark.createDataFrame(rows, "key string, place string, name string"), "place", "key", "name").collect()] == ["2"]
