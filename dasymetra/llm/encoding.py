"""Names decoded with the wrong encoding: found and restored by expectation-maximisation over latent chains."""

from __future__ import annotations

import functools
import math
import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dasymetra.plans.common import cut_lineage, salted_join

#: Single-byte encodings with which text may have been read by mistake (fixed values).
READ_AS = ("latin_1", "cp1252", "cp1250", "cp1251", "cp437", "cp850", "cp866", "koi8_r", "mac_roman")
#: Encodings in which it may have been written, besides UTF-8.
WRITTEN_IN = ("cp1252", "cp850", "mac_roman")
#: Characters beyond ASCII that names are expected to hold.
REPERTOIRE = "".join(chr(c) for c in range(0xA1, 0x100)) + "–—‘’“”…€ŒœŠšŽžŸ"
CLEAN = "clean"
LOST_CHAIN = "lost"
#: What stands for a letter that was lost: the replacement character, control characters beyond ASCII, and a question mark inside a word. In readings a wildcard takes its place.
LOST = re.compile("[\ufffd\x80-\x9f]|(?<=[^\\W\\d_])[?](?=[^\\W\\d_])")
WILD = "\x01"
#: One letter may be lost for each sign, for each two, or for each with a letter before it that begins many garbled forms.
WAYS = (LOST, re.compile("[\ufffd\x80-\x9f]{2}|" + LOST.pattern), re.compile("[ÃãÂâ][\ufffd\x80-\x9f]|" + LOST.pattern))
#: Character n-grams are counted in two rows of hashed buckets, the lesser of which counts: the size of the model, whatever the corpus.
BUCKETS = 1 << 19
ORDER = 5
#: Letters that a wildcard may be.
LETTERS = 30
#: Readings of tokens that a worker remembers, and prefixes that the search for lost letters goes on with: as many as two letters can make.
MOST_TOKENS, BEAM = 200_000, 2_500
#: Log probabilities that a chain garbled a token which it could have garbled, and that it left it alone.
TAKEN, LEFT = math.log(0.8), math.log(0.2)


def _read(raw: bytes, encoding: str) -> str | None:
    """Decode; bytes that the encoding leaves undefined become control characters, as most readers do."""
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        return "".join(_one(b, encoding) for b in raw)


def _one(b: int, encoding: str) -> str:
    try:
        return bytes([b]).decode(encoding)
    except UnicodeDecodeError:
        return chr(b)


def _written(text: str, encoding: str) -> bytes | None:
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        return None


@dataclass
class Chain:
    """One way of garbling, as the table of what each character turns into and the pattern that finds those."""

    name: str
    back: dict[str, str] = field(default_factory=dict)
    #: second readings of forms in which changed case made two characters alike
    other: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self.pattern = re.compile("|".join(map(re.escape, sorted(self.back, key=len, reverse=True)))) if self.back else None
        self.foreign = {g: c for g, c in self.back.items() if any(not _latin(x) for x in g)}
        self.foreign_pattern = re.compile("|".join(map(re.escape, sorted(self.foreign, key=len, reverse=True)))) if self.foreign else None

    def options(self, token: str) -> list[str]:
        """What the token may have been: all garbled parts undone, or only those with a character that is no Latin letter."""
        out = []
        for table in (self.back, {**self.back, **self.other}) if self.other else (self.back,):
            for pattern in (self.pattern, self.foreign_pattern):
                if pattern is not None:
                    undone = pattern.sub(lambda m: table[m.group()], token)
                    if undone != token and undone not in out:
                        out.append(undone)
        return out


def _latin(c: str) -> bool:
    return c.isascii() or (c.isalpha() and unicodedata.name(c, "").startswith("LATIN "))


@functools.lru_cache(1)
def chains() -> list[Chain]:
    """All chains: UTF-8 read in a single-byte encoding, once or twice over, and one single-byte encoding read as another.

    The garbled form of a character is kept as it is and in lower, upper and title case, since names change
    case after they were garbled; the restored character then changes its case with it.
    """
    steps: list[tuple[str, list[tuple[str, str]]]] = [(f"utf_8>{r}", [("utf_8", r)]) for r in READ_AS]
    steps += [(f"utf_8>{r}>utf_8>{r}", [("utf_8", r)] * 2) for r in ("latin_1", "cp1252", "mac_roman")]
    steps += [(f"{w}>{r}", [(w, r)]) for w in WRITTEN_IN for r in READ_AS if w != r and not (w == "cp1252" and r == "latin_1")]
    out = []
    for name, pairs in steps:
        exact, varied, second = {}, {}, {}
        for c in REPERTOIRE:
            garbled = c
            for w, r in pairs:
                raw = _written(garbled, w)
                garbled = None if raw is None else _read(raw, r)
                if garbled is None:
                    break
            if garbled is None or garbled == c or garbled.isascii():
                continue
            exact.setdefault(garbled, c)
            for change in (str.lower, str.upper, str.title):
                if (other := change(garbled)) != garbled and len(other) == len(garbled) and not other.isascii():
                    was = c.upper() if change is str.upper and len(c.upper()) == 1 else c.lower()
                    if varied.setdefault(other, was) != was:
                        second.setdefault(other, was)
        out.append(Chain(name, varied | exact, {g: c for g, c in second.items() if g not in exact}))
    return out


@functools.lru_cache(MOST_TOKENS)
def forms(token: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """(chain, readings) of each chain that may have garbled the token; it does not depend on the model, so a worker keeps it from round to round."""
    out = []
    if not token.isascii():
        for chain in chains():
            if options := chain.options(token):
                out.append((chain.name, tuple(dict.fromkeys(LOST.sub(WILD, o) for o in options))))
    if LOST.search(token):
        out.append((LOST_CHAIN, tuple(dict.fromkeys(w.sub(WILD, token) for w in WAYS))))
    return tuple(out)


@functools.lru_cache(1)
def _bases() -> np.ndarray:
    """Probability of a character that was never seen: small beyond ASCII and smaller beyond Latin letters."""
    return np.array([1e-3 if c < 0x80 else 1e-5 if _latin(chr(c)) else 1e-7 for c in range(0x10000)])


class Grams:
    """Folded strings end to end, each between a start sign and a space, with the buckets of the n-grams that end at each character."""

    def __init__(self, strings: list[str], end: bool = True):
        folded = [x if len(x := s.lower()) == len(s) else s for s in strings]
        text = "".join("\x02" + s + " " if end else "\x02" + s for s in folded)
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.array([len(s) + (2 if end else 1) for s in folded])
        self.start = np.cumsum(length) - length
        self.owner = np.repeat(np.arange(len(strings)), length)
        at = np.arange(len(self.codes))
        self.wild = self.codes == ord(WILD)
        first = self.start[self.owner]
        behind = np.maximum.accumulate(np.where(self.wild, at + 1, 0)) if self.wild.any() else 0
        #: how many characters before each may count as its context: no start sign or wildcard is crossed
        self.reach = at - np.maximum(first, behind)
        self.reach[self.wild] = -1
        self.first = at == first
        self.rows = []
        h = np.zeros(len(at), np.uint64)
        for _ in range(ORDER):
            h = np.concatenate([np.zeros(1, np.uint64), h[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + self.codes + np.uint64(0x632BE59BD9B4E019)
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            self.rows.append(((mixed >> np.uint64(40)) % np.uint64(BUCKETS), np.uint64(BUCKETS) + (mixed >> np.uint64(8)) % np.uint64(BUCKETS)))

    def count(self, into: np.ndarray, weights: np.ndarray) -> None:
        """Add each string's weight to its n-grams; the last of ``into`` is the number of characters."""
        each = weights[self.owner]
        for n, pair in enumerate(self.rows):
            at = np.flatnonzero((self.reach >= n) & ((n == 0) | ~self.first))
            for g in pair:
                np.add.at(into, g[at], each[at])
        into[-1] += each[~self.first & ~self.wild].sum()

    def scores(self, counts: np.ndarray, weight: float) -> np.ndarray:
        """Log probability of each string: a character's given up to four before it backs off to shorter contexts."""
        p = _bases()[np.minimum(self.codes, 0xFFFF)]
        context = np.full(len(p), counts[-1])
        for n, (a, b) in enumerate(self.rows):
            have = np.minimum(counts[a], counts[b])
            p = np.where(self.reach >= n, (np.minimum(have, context) + weight * p) / (context + weight), p)
            context = np.concatenate([[0.0], have[:-1]])
        p[self.wild] = 1 / LETTERS
        p[self.first] = 1.0
        return np.add.reduceat(np.log(p), self.start) if len(self.start) else np.empty(0)


class Model:
    """Hashed character n-grams of what names look like, and how likely each chain is in each field of each source."""

    def __init__(self, counts: np.ndarray, priors: dict[tuple[str, str, str], float], rare: float = 1e-6, weight: float = 0.5):
        self.counts, self.priors, self.rare, self.weight = counts, priors, rare, weight
        self.known: dict[str, float] = {}
        self.letters: list[str] | None = None

    def prior(self, place: str, source: str, chain: str) -> float:
        return math.log(max(self.rare, self.priors.get((place, source, chain), 0.0)))

    def scores(self, strings, end: bool = True) -> np.ndarray:
        strings = list(strings)
        out = np.empty(len(strings))
        for at in range(0, len(strings), 20_000):
            part = strings[at : at + 20_000]
            out[at : at + len(part)] = Grams(part, end).scores(self.counts, self.weight)
        return out

    def readings(self, texts: list[str]) -> list[list[tuple[str, str, float]]]:
        """(chain, what the text was, log likelihood) of every reading of each text; the clean reading comes first. A text that no chain can have garbled has that one alone, of likelihood 1."""
        split = [t.split(" ") for t in texts]
        taken = [any(map(forms, tokens)) for tokens in split]
        wanted = {t for tokens, some in zip(split, taken) if some for t in tokens}
        wanted |= {o for t in wanted for _, options in forms(t) for o in options}
        new = [w for w in wanted if w not in self.known]
        if len(self.known) + len(new) > MOST_TOKENS:
            self.known, new = {}, list(wanted)
        self.known.update(zip(new, self.scores(new).tolist()))
        known, best, out = self.known, {}, []
        for text, tokens, some in zip(texts, split, taken):
            if not some:
                out.append([(CLEAN, text, 0.0)])
                continue
            for t in tokens:
                if t not in best:
                    # a chain mostly takes the whole text; what it could have taken and did not is less likely. Letters may be lost besides
                    ways = dict(forms(t))
                    take = lambda c: [(known[o] + TAKEN - math.log(len(ways[c])), o) for o in ways.get(c, ())]
                    alone = max([(known[t], t), *take(LOST_CHAIN)])
                    best[t] = {c: max([(alone[0] + LEFT, alone[1]), *take(c)]) for c in ways} | {None: alone}
            plain = [known[t] for t in tokens]
            here = [(CLEAN, text, sum(plain))]
            for chain in sorted({c for t in tokens for c in best[t] if c is not None}):
                ways = [best[t].get(chain, best[t][None]) for t in tokens]
                was = " ".join(w for _, w in ways)
                if was != text:
                    here.append((chain, was, sum(x for x, _ in ways)))
            out.append(here)
        return out

    def posteriors(self, place: str, source: str, readings: list[tuple[str, str, float]]) -> list[float]:
        if len(readings) == 1:
            return [1.0]
        logs = [self.prior(place, source, c) + x for c, _, x in readings]
        top = max(logs)
        weights = [math.exp(x - top) for x in logs]
        whole = sum(weights)
        return [w / whole for w in weights]

    def filled(self, text: str) -> str:
        """The text with the likeliest letter for each wildcard, one token at a time; exact for up to two in a token, by a beam over prefixes beyond."""
        if self.letters is None:
            marks = [c for c in REPERTOIRE if c.isalpha() and c not in "ªº" and c == c.lower()]
            grams = Grams(marks, False)
            at = np.flatnonzero(~grams.first)
            self.letters = [c for c, n in zip(marks, np.minimum(*[self.counts[g[at]] for g in grams.rows[0]])) if n >= 1]
        out = []
        for token in text.split(" "):
            if WILD in token:
                upper = token.upper() == token
                marks = [c.upper() if upper and len(c.upper()) == 1 else c for c in self.letters]
                beam = [token]
                while WILD in beam[0]:
                    grown = sorted({t.replace(WILD, c, 1) for t in beam for c in marks})
                    last = WILD not in grown[0]
                    order = self.scores(grown if last else [t[: t.index(WILD)] for t in grown], last)
                    beam = [grown[k] for k in np.argsort(-order, kind="stable")[: 1 if last else BEAM]]
                    if not beam:
                        beam = [token.replace(WILD, "\ufffd")]
                token = beam[0]
            out.append(token)
        return " ".join(out)


def _looks_plain(text: str) -> bool:
    """ASCII and letters of Latin-1 alone, and no sign of a lost letter: what the first round takes as clean."""
    return not LOST.search(text) and all(c.isascii() or (c <= "ÿ" and _latin(c)) for c in text)


def _sums(batches, work):
    """Run ``work(batch, tokens, chances)``, which adds weights of tokens and of (place, source, chain), over all batches, and give the partition's sums as one batch."""
    tokens, chances = Counter(), Counter()
    counts = np.zeros(2 * BUCKETS + 1)

    def spill():
        if tokens:
            Grams(list(tokens)).count(counts, np.array(list(tokens.values())))
        tokens.clear()

    for batch in batches:
        work(batch, tokens, chances)
        if len(tokens) > 100_000:
            spill()
    spill()
    buckets = np.flatnonzero(counts)
    names = list(chances)
    column = lambda k: pa.array([*[None] * len(buckets), *[n[k] for n in names]], pa.string())
    yield pa.RecordBatch.from_arrays(
        [pa.array([*buckets.tolist(), *[-1] * len(names)], pa.int64()), column(0), column(1), column(2), pa.array([*counts[buckets].tolist(), *[chances[n] for n in names]], pa.float64())],
        names=["bucket", "place", "source", "chain", "weight"])


def fit(names: DataFrame, rounds: int = 8, settled: float = 1e-3) -> Model:
    """Fit the model to all names by expectation-maximisation.

    names: (place, source, text, n), each text once per place and source and materialised, as each round reads it. The first
    round takes as clean what is made of ASCII and letters of Latin-1. Each later round weighs the
    readings of a text by their posterior under the last model, adds the n-grams of the clean reading and of
    the likeliest restored one, and counts the chains of each place and source; it is the last one once no prior
    moves by more than ``settled``. What a task returns is at most the
    buckets and one number for each place, source and chain, and the driver gathers no more than that.
    """
    spark = names.sparkSession
    model: Model | None = None
    for _ in range(rounds):
        shared = None if model is None else spark.sparkContext.broadcast((model.counts, model.priors))

        def run(batches, shared=shared):
            now, every = None if shared is None else Model(*shared.value), [c.name for c in chains()] + [LOST_CHAIN]

            def add(tokens, text, weight):
                for token in text.split(" "):
                    tokens[token] += weight

            def work(batch, tokens, chances):
                place, source, text, n = (batch.column(k).to_pylist() for k in range(4))
                readings = [None] * len(text) if now is None else now.readings(text)
                for where, of, t, k, here in zip(place, source, text, n, readings):
                    if here is None:
                        clean = _looks_plain(t)
                        if clean:
                            add(tokens, t, float(k))
                        chances[where, of, CLEAN] += k if clean else 0
                        for c in () if clean else every:
                            chances[where, of, c] += k / len(every)
                        continue
                    chance = now.posteriors(where, of, here)
                    for (chain, _, _), p in zip(here, chance):
                        chances[where, of, chain] += k * p
                    add(tokens, t, k * chance[0])
                    if len(here) > 1:
                        best = max(range(1, len(here)), key=chance.__getitem__)
                        add(tokens, here[best][1], k * (1 - chance[0]))

            yield from _sums(batches, work)

        sums = names.select("place", "source", "text", "n").mapInArrow(run, "bucket bigint, place string, source string, chain string, weight double")
        got = sums.groupBy("bucket", "place", "source", "chain").agg(F.sum("weight").alias("weight")).toArrow()
        if shared is not None:
            shared.destroy()
        bucket, weight = got.column("bucket").to_numpy(), got.column("weight").to_numpy()
        counts = np.zeros(2 * BUCKETS + 1)
        counts[bucket[bucket >= 0]] = weight[bucket >= 0]
        named = got.filter(pa.compute.less(got.column("bucket"), 0)).to_pylist()
        chances = {(r["place"], r["source"], r["chain"]): r["weight"] for r in named}
        total = Counter()
        for k, x in chances.items():
            total[k[:2]] += x
        before = {} if model is None else model.priors
        model = Model(counts, {k: (x + 0.01) / (total[k[:2]] + 1) for k, x in chances.items()})
        if before and max((abs(x - before.get(k, 0.0)) for k, x in model.priors.items()), default=0.0) < settled:
            break
    return model


def _verdict(model: Model, place: str, source: str, text: str, readings: list[tuple[str, str, float]], least: float) -> tuple[str, float, str | None] | None:
    chance = model.posteriors(place, source, readings)
    if len(readings) == 1 or 1 - chance[0] < least:
        return None
    by_text = Counter()
    for (_, t, _), p in zip(readings[1:], chance[1:]):
        by_text[t] += p
    restored = by_text.most_common(1)[0][0]
    chain = max((p, c) for (c, t, _), p in zip(readings[1:], chance[1:]) if t == restored)[1]
    if WILD in restored or LOST.search(restored):
        ways = {w.sub(WILD, t.replace(WILD, "\ufffd")) for t in (restored, text) for w in WAYS}
        ways = sorted({model.filled(w) for w in ways if WILD in w})
        restored, chain = ways[int(np.argmax([model.scores(w.split(" ")).sum() for w in ways]))], LOST_CHAIN
    return chain, 1 - chance[0], restored if restored != text and not re.search("[\ufffd\x80-\x9f]", restored) else None


def distinct_names(records: DataFrame, place: str, text: str, source: str | None = None) -> DataFrame:
    """(place, source, text, n): each text once per place and source, written once; equal texts collapse before the shuffle. Null and empty texts are left out, a null place or source counts as an empty one."""
    names = _keyed(records, place, source, text).filter(F.length("text") > 0).groupBy("place", "source", "text").agg(F.count(F.lit(1)).alias("n"))
    # far fewer rows than records, but each costs much: once over all cores, one text's rows side by side
    return cut_lineage(names.repartition(records.sparkSession.sparkContext.defaultParallelism, "text").sortWithinPartitions("text"))


def _keyed(records: DataFrame, place: str, source: str | None, text: str, *more) -> DataFrame:
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    return records.select(name(place).alias("place"), F.lit("").alias("source") if source is None else name(source).alias("source"), F.col(f"`{text}`").cast("string").alias("text"), *more)


def garbled_names(names: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(place, source, text, n, chain, posterior, restored) of the garbled texts among ``names``, each judged once.

    A text counts as garbled if its readings through some chain together have a posterior of ``least`` or
    more; the loss of letters is a chain like others. restored is the likeliest reading, with the likeliest
    letters in place of lost ones; null where nothing better than the text itself is found.
    """
    shared = names.sparkSession.sparkContext.broadcast((model.counts, model.priors))

    def run(batches):
        now = Model(*shared.value)
        for batch in batches:
            place, source, text, n = (batch.column(k).to_pylist() for k in range(4))
            out = [(w, s, t, k, *v) for w, s, t, k, here in zip(place, source, text, n, now.readings(text)) if (v := _verdict(now, w, s, t, here, least))]
            columns = list(zip(*out)) or [()] * 7
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["place", "source", "text", "n", "chain", "posterior", "restored"])

    return names.select("place", "source", "text", "n").mapInArrow(run, "place string, source string, text string, n bigint, chain string, posterior double, restored string")


def repair(records: DataFrame, place: str, key: str, text: str, source: str | None = None, rounds: int = 8) -> DataFrame:
    """(place, source, rec_key, text, chain, posterior, restored) of each record whose text is garbled.

    place: the field that a text is from; source: the delivery. Fits the model to all texts, judges each distinct text once and joins the
    garbled ones, few as they are, back to the records, those of very frequent texts split. Null and empty texts are never garbled; repeated rows are all returned; texts of
    any length are judged whole; an empty table gives an empty result.
    """
    names = distinct_names(records, place, text, source)
    garbled = cut_lineage(garbled_names(names, fit(names, rounds)))
    rows = _keyed(records, place, source, text, F.col(f"`{key}`").cast("string").alias("rec_key"))
    on = ["place", "source", "text"]
    return salted_join(rows, garbled.drop("n"), on, 200_000, garbled.select(*on, "n")).select(*on[:2], "rec_key", "text", "chain", "posterior", "restored")
