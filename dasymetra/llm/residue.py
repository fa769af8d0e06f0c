"""Template residue, filler, error messages and script notices in texts, by likelihood-ratio windows."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dasymetra.llm.residue_seeds import ALONE, BRACKETS, FILLER, MARKER_WORDS, NOTICE
from dasymetra.plans.common import cut_lineage, free_name

ORDER = 5
#: Buckets of the hashed character n-grams of pieces, and of those of shapes: the size of a model, whatever the corpus.
BUCKETS, SHAPES = 1 << 21, 1 << 18
SEED_WEIGHT = 3.0
#: Characters that are judged at a time, which bounds a task's memory; a longer text is judged in blocks.
BLOCK = 100_000
CLASSES = ("filler", "notice")

_TAGS = re.compile(r"</?(?:p|br|b|i|u|em|strong|div|span|h[1-6]|ul|ol|li|tr|td|table)\b[^<>\0]*>", re.I)
#: Signs that stand for the markers of residue_seeds, and for words beside one, in shapes.
MARKER, BESIDE, BESIDES = 0xE000, 0xE100, 4096
_NAME = f"[aAT09_{chr(MARKER)}-{chr(BESIDE + BESIDES)}]"
_ALONE_SIGNS = "".join(chr(MARKER + MARKER_WORDS.index(w)) for w in ("undefined", "nan", "tbd", "null"))
_XX = f"[{chr(MARKER + MARKER_WORDS.index('xx'))}{chr(MARKER + MARKER_WORDS.index('xxxx'))}]"
#: The forms of unfilled placeholders in shapes: a name between marks, or a mark alone. Whether one is a placeholder, the model decides.
FORM = re.compile(
    rf"\{{\{{[^{{}}]*\}}\}}|[$#]\{{{_NAME}[^{{}} ]*\}}|\{{[^{{}}]*\}}|<%(?:(?!<%|%>).)*%>|\{{%(?:(?!\{{%|%\}}).)*%\}}|<<[^<>]+>>|</?{_NAME}[^<>]*>|\[\[[^\[\]]*\]\]|\[{_NAME}[^\[\]]*\]|\(\([^()]+\)\)|\([{_ALONE_SIGNS}]\)"
    rf"|%\([^()]+\)[aT]?|%{_NAME}+%|%(?:[09]\$)?[aT]|\${_NAME}+\$|\$0|~{_NAME}+~|__{_NAME}*__|__+|@@{_NAME}+@@|&&{_NAME}+&&|{_XX}([/.-]){_XX}\1{_XX}|\?{{3,}}|#A(?:/A|[!?]|/0!)|(?<![aAT])[Ta]/[Ta](?![aAT])"
    rf"|[{_ALONE_SIGNS}](?:[{chr(BESIDE)}-{chr(BESIDE + BESIDES)}])?")  # fmt: skip

LETTER, DIGIT, SPACE, INVISIBLE = 1, 2, 3, 4
_HIDDEN = {0xAD, 0xFEFF, *range(0x200B, 0x2010), *range(0x2060, 0x2065)}


@functools.lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower case, kind and whether it is upper case of each character up to U+FFFF; those beyond are letters as they are."""
    chars = [chr(c) for c in range(0x10000)]
    lower = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars], np.uint32)
    kind = np.array([INVISIBLE if i in _HIDDEN else DIGIT if "0" <= c <= "9" else LETTER if c.isalpha() else SPACE if c.isspace() else 0 for i, c in enumerate(chars)], np.uint8)
    return lower, kind, np.array([c.isupper() for c in chars])


def _before(a: np.ndarray, first=False) -> np.ndarray:
    return np.concatenate([[first], a[:-1]]) if len(a) else a


def _after(a: np.ndarray, last=False) -> np.ndarray:
    return np.concatenate([a[1:], [last]]) if len(a) else a


def _is(codes: np.ndarray, chars: str) -> np.ndarray:
    out = codes == ord(chars[0])
    for c in chars[1:]:
        out |= codes == ord(c)
    return out


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Laid:
    """Texts end to end as character codes, each followed by a zero, without markup and invisible characters."""

    def __init__(self, texts: list[str]):
        joined = "\0".join([t.replace("\0", " ") if "\0" in t else t for t in texts] + [""])
        if "<" in joined:
            joined = _TAGS.sub("\n", joined)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lower, kinds, upper = _tables()
        small = np.minimum(codes, 0xFFFF)
        kind = np.where(codes > 0xFFFF, LETTER, kinds[small]).astype(np.uint8)
        if (hidden := kind == INVISIBLE).any():
            codes, small, kind = codes[~hidden], small[~hidden], kind[~hidden]
        self.codes, self.kind, self.upper = codes, kind, upper[small]
        self.low = np.where(codes > 0xFFFF, codes, lower[small]).astype(np.uint32)
        self.n = len(texts)

    def pieces(self) -> tuple[Stream, np.ndarray]:
        """The pieces of all texts, mostly sentences, as the models read them, and the text that each is from.

        In lower case, each number one sign, each hexadecimal id one sign, spaces single; what numbers a piece or leads it as a path is left out.
        """
        c, kind = self.low.copy(), self.kind
        digit = kind == DIGIT
        drop = digit & _before(digit)
        c[digit] = ord("0")
        start, end = _runs(digit | (kind == LETTER) | (self.codes == ord("_")))
        long = end - start >= 6
        start, end = start[long], end[long]
        hexes = np.concatenate([[0], np.cumsum(digit | ((self.low >= ord("a")) & (self.low <= ord("f"))))])
        digits = np.concatenate([[0], np.cumsum(digit)])
        some = digits[end] - digits[start]
        at = (hexes[end] - hexes[start] == end - start) & (some > 0) & (some < end - start)
        for a, b in zip(start[at], end[at]):
            c[a], drop[a : b] = ord("h"), True
            drop[a] = False
        space = kind == SPACE
        line = self.codes == 10
        c[space] = ord(" ")
        # a run of spaces keeps its first, and is a line break if it holds one
        s, e = _runs(space)
        lines = np.concatenate([[0], np.cumsum(line)])
        c[s[lines[e] > lines[s]]] = 10
        drop |= space & _before(space)
        c = c[~drop]
        gap = (c == ord(" ")) | (c == 10)
        dash = _is(c, "–—") & _before(gap) & _after(gap)
        cut = _is(c, "|;\n\0") | dash
        stop = ((_is(c, ".!?…:：")) & _after(gap)) | _is(c, "。！？")
        first = _before(cut | stop, True)
        blank = (c == ord(" ")) & (first | _after(cut, True) | _before(first & (c == ord(" "))) | _before(cut, True))
        owner = np.cumsum(c == 0)
        number = np.cumsum(first)
        kept = ~cut & ~blank
        c, number, owner = c[kept], number[kept], owner[kept]
        if not len(c):
            return Stream(c, np.empty(0, np.int64), np.empty(0, np.int64)), owner
        start = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        end = np.concatenate([start[1:], [len(c)]])
        gaps = np.concatenate([np.flatnonzero(c == ord(" ")), [len(c)]])
        gap = gaps[np.searchsorted(gaps, start)]
        other = np.concatenate([[0], np.cumsum(~_is(c, "0/.-[]"))])
        led = (gap < end) & ((other[np.minimum(gap, len(c))] == other[start]) | (c[start] == ord("/")))
        owner = owner[start]
        return Stream(c, np.where(led, gap + 1, start), end), owner

    def shapes(self) -> Stream:
        """One shape per text: marks without their words. A word is one letter that tells its case, unless it is a marker; a number is one digit, another if it is longer."""
        # a space before and behind each text, which runs together with its own
        zero = np.flatnonzero(self.codes == 0)
        led = np.concatenate([[0], zero[:-1] + 1]) if len(zero) else zero
        c, kind, upper, low = (np.insert(a, np.concatenate([led, zero]), x) for a, x in ((self.codes, ord(" ")), (self.kind, SPACE), (self.upper, False), (self.low, ord(" "))))
        c[kind == SPACE] = ord(" ")
        drop = np.zeros(len(c), bool)
        for k in (LETTER, DIGIT, SPACE):
            mask = kind == k
            drop |= mask & _before(mask)
        s, e = _runs(kind == DIGIT)
        c[s] = np.where(e - s == 1, ord("0"), ord("9"))
        s, e = _runs(kind == LETTER)
        if len(s):
            ups = np.concatenate([[0], np.cumsum(upper)])
            up, size = ups[e] - ups[s], e - s
            word = np.where((up == size) & (size > 1), ord("A"), np.where(upper[s] & (up == 1), ord("T"), ord("a")))
            hashes = np.zeros(len(s), np.uint64)
            for i in range(_LONGEST):
                hashes = np.where(size > i, hashes * np.uint64(1_000_003) + low[np.minimum(s + i, len(c) - 1)].astype(np.uint64) + np.uint64(1), hashes)
            keys, signs = _markers()
            found = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            marker = (keys[found] == hashes) & (size <= _LONGEST)
            # what stands behind a marker tells whether it is one: that word keeps a sign of its own
            alone = marker & _is(signs[found], _ALONE_SIGNS)
            # programs write null or NULL; Null begins a sentence
            marker &= ~(alone & upper[s] & (up == 1) & (size > 1))
            alone &= marker
            beside = _before(alone & (_after(s, -1) == e + 1)) & (kind[np.maximum(s - 1, 0)] == SPACE)
            c[s] = np.where(marker, signs[found], np.where(beside, BESIDE + (hashes % np.uint64(BESIDES)).astype(np.int64), word))
            drop[s[beside] - 1] = True
        c = c[~drop]
        zero = np.flatnonzero(c == 0)
        return Stream(c, np.concatenate([[0], zero[:-1] + 1]) if len(zero) else zero, zero, SHAPES)


_LONGEST = max(map(len, MARKER_WORDS))


@functools.lru_cache(1)
def _markers() -> tuple[np.ndarray, np.ndarray]:
    hashes = []
    for w in MARKER_WORDS:
        h = 0
        for c in w:
            h = (h * 1_000_003 + ord(c) + 1) % (1 << 64)
        hashes.append(h)
    order = np.argsort(np.array(hashes, np.uint64))
    return np.array(hashes, np.uint64)[order], (MARKER + order).astype(np.uint32)


class Stream:
    """Spans of character codes end to end, each led by enough separators that no context crosses over, with the buckets of the n-grams that end at each place."""

    def __init__(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int = BUCKETS):
        length = end - start
        total, n = int(length.sum()), len(start)
        self.codes, self.spans = codes, (start, end)
        self.end = np.cumsum(length + ORDER)
        self.start = self.end - length
        self.owner = np.repeat(np.arange(n), length)
        self.place = np.arange(total) + ORDER * (self.owner + 1)
        raw = np.full(total + ORDER * n, 10, np.uint64)
        self.source = np.arange(total) - np.repeat(np.cumsum(length) - length, length) + np.repeat(start, length)
        raw[self.place] = codes[self.source]
        self.many = raw >= 0x2E80  # kana and ideographs, of which one says as much as several letters
        self.size, self.buckets, self.grams = len(raw), buckets, []
        h = np.zeros(len(raw), np.uint64)
        for _ in range(ORDER):
            # the n-gram that ends at each place, from the shorter one that ends just before it
            h = np.concatenate([np.zeros(1, np.uint64), h[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + raw + np.uint64(0x632BE59BD9B4E019)
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            self.grams.append(((mixed ^ (mixed >> np.uint64(32))) & np.uint64(buckets - 1)).astype(np.int32))

    def text(self, k: int) -> str:
        start, end = self.spans
        return self.codes[start[k] : end[k]].tobytes().decode("utf-32-le", "surrogatepass")

    def count(self, into: np.ndarray, chosen: np.ndarray | None = None) -> None:
        """Add the n-grams that end inside spans, and the contexts before the first character, to ``into``; chosen: of which spans, all if None."""
        if not len(self.start):
            return
        # the character before a span is the separator: its n-grams are the contexts of the first character
        first, place = self.start - 1, self.place
        if chosen is not None:
            first, place = first[chosen], place[chosen[self.owner]]
        at = np.concatenate([first, place])
        grams = np.concatenate([g[at] for g in self.grams])
        if len(grams) * 4 > self.buckets:
            into += np.bincount(grams, minlength=self.buckets)
        else:
            np.add.at(into, grams, 1.0)

    def log_probabilities(self, table: np.ndarray, totals: np.ndarray, orders: list[np.ndarray | int]) -> np.ndarray:
        """(character, model) log probability of each character given those before it, each longer context interpolated with the shorter.

        table: (bucket, 2 or 4 models) counts. orders: for each model how many characters an n-gram may have, one number or one for each character.
        """
        models = table.shape[1]
        rows = table.view({2: np.float64, 4: np.complex128}[models])[:, 0]  # the numbers of a bucket are fetched as one
        p = np.full((self.size, models), 1 / 20_000, np.float32)
        limits = None
        if any(not np.isscalar(o) or o < ORDER for o in orders):
            limits = np.full((self.size, models), ORDER)
            for k, o in enumerate(orders):
                limits[self.place, k] = o
        context = np.broadcast_to(np.array(totals, np.float32), p.shape)
        least = np.empty_like(p)
        for n, g in enumerate(self.grams):
            have = rows[g].view(np.float32).reshape(self.size, models)
            # an unseen character costs a context at most a factor of 33, whatever the context's count
            shorter = context * np.float32(0.03)
            shorter += np.float32(1)
            now = p * shorter if limits is not None else np.multiply(p, shorter, out=p)
            now += np.minimum(have, context, out=least)
            shorter += context
            now /= shorter
            if limits is not None:
                p = np.where(limits > n, now, p)
            # what stands before each character
            context = np.concatenate([np.zeros((1, models), np.float32), have[:-1]])
        return np.log(p[self.place])


def covered(stream: Stream, ratio: np.ndarray, width: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each span, the share of its characters inside windows whose mean log likelihood ratio is ``least`` or more, and the sum of the ratios there; and for each character whether it is inside one.

    Windows are ``width`` characters long, shorter only where a span is.
    """
    length = stream.end - stream.start
    last = np.cumsum(length)
    first = last - length
    sums = np.concatenate([[0.0], np.cumsum(ratio, dtype=np.float64)])
    place = np.arange(len(ratio))
    stop = np.minimum(place + width, last[stream.owner])
    begin = np.maximum(stop - width, first[stream.owner])
    hot = (sums[stop] - sums[begin]) >= least * (stop - begin)
    marks = np.bincount(begin[hot], minlength=len(ratio) + 1) - np.bincount(stop[hot], minlength=len(ratio) + 1)
    inside = np.cumsum(marks)[:-1] > 0
    total = np.concatenate([[0], np.cumsum(inside)])
    gain = np.concatenate([[0.0], np.cumsum(inside * ratio)])
    return (total[last] - total[first]) / np.maximum(1, length), gain[last] - gain[first], inside


@dataclass(frozen=True)
class Settings:
    """width, ratio: length and least mean log likelihood ratio of a window; coverage, evidence: least covered share and summed ratio of a piece of residue.

    floor: least that one character's ratio counts. beside: the same two for a piece beside a surer one, from which the models learn. shape_*: the windows on marks, and the least sum of ratios of a
    placeholder; pair: how much likelier a word that prose has seen beside a marker is there than any. first_*: the stricter values of the first round, whose prose model looks back one character, or none in scripts of many characters; first_coverage is for filler and for notices. pool: what
    the first two are multiplied by for a text to be looked at again in later rounds.
    """

    width: int = 14
    ratio: float = 0.5
    coverage: float = 0.6
    evidence: float = 8.0
    beside: tuple[float, float] = (0.5, 4.0)
    first_ratio: float = 0.7
    first_coverage: tuple[float, float] = (0.65, 0.85)
    first_order: int = 2
    pool: float = 0.5
    shape_width: int = 3
    shape_ratio: float = 0.1
    shape_evidence: float = 1.0
    shape_floor: float = -6.0
    pair: float = 20.0
    floor: float = -3.0


@dataclass
class Models:
    """Counts by bucket of prose, filler and notice (and a column of zeros), and of the shapes of prose and placeholders, each with its number of characters. first: whether prose still holds all texts."""

    text: np.ndarray
    shape: np.ndarray
    first: bool

    def __post_init__(self):
        self.totals = [np.maximum(1.0, t.sum(axis=0, dtype=np.float64) / ORDER) for t in (self.text, self.shape)]


    def packed(self) -> tuple[list[bytes], bool]:
        """Compressed, as the models travel: most buckets of a small corpus are empty."""
        return [pa.compress(np.ascontiguousarray(t.T).tobytes(), "zstd", asbytes=True) for t in (self.text, self.shape)], self.first

    @staticmethod
    def unpacked(packed: tuple[list[bytes], bool]) -> Models:
        shapes = ((4, BUCKETS), (2, SHAPES))
        tables = [np.frombuffer(pa.decompress(b, 4 * n * size, "zstd", asbytes=True), np.float32).reshape(n, size) for b, (n, size) in zip(packed[0], shapes)]
        return Models(*[np.ascontiguousarray(t.T) for t in tables], packed[1])


def _seeded(texts: list[str], shape: bool) -> np.ndarray:
    laid = Laid(texts)
    out = np.zeros(SHAPES if shape else BUCKETS)
    (laid.shapes() if shape else laid.pieces()[0]).count(out)
    return SEED_WEIGHT * out


@functools.lru_cache(1)
def seed_counts() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of filler, notices and placeholders from the seeds alone; placeholders are made from marks by rule."""
    inner = ("aa", "aa_aa", "aa.aa", "AA", "AA_AA", "Aa", "aa aa", "Aa aa", "insert aa here", "INSERT AA HERE", "insert AA_AA here", "insert aa_aa here", "inserir aa", "inserir AA", "inserir aa_aa", "aa.aa | upper", "0", "0:aa", "0:AA")
    marks = [f"{b}{w}{e}" for b, e in BRACKETS for w in inner] + 20 * list(ALONE)  # as often as those in brackets
    around = [" aa {} aa ", " {} aa ", " aa {}. ", " aa {}, aa ", " “{} aa ", " aa ({}) ", "{} aa aa ", " aa, {} aa ", " aa, {}. ", " aa; {} aa ", " aa {}? ", " „{} aa ", " «{} aa ", "aa、{}aa", "aa「{}aa"]
    around += [" Aa {} aa ", " {} Aa ", " Aa {}, Aa ", " Aa, {} aa ", " aa {}; aa ", " {}; aa ", "{}, aa ", " aa {}: aa ", " 99 {} aa "]
    return _seeded(FILLER, False), _seeded(NOTICE, False), _seeded([a.format(m) for m in marks for a in around], True)


@dataclass
class Verdict:
    """Of a batch: its pieces with their text and class (-1: none), how sure a doubtful one is, and the shapes with whether a placeholder is in them."""

    stream: Stream
    owner: np.ndarray
    kind: np.ndarray
    pool: np.ndarray
    beside: np.ndarray
    shapes: Stream
    marked: np.ndarray


def judge(texts: list[str], models: Models, s: Settings) -> Verdict:
    laid = Laid(texts)
    stream, owner = laid.pieces()
    n = len(stream.start)
    kind, best = np.full(n, -1), np.full(n, -np.inf)
    doubt, beside = np.zeros(n, bool), np.full(n, -1)
    if n:
        order = ORDER
        if models.first:
            order = np.where(stream.many[stream.place], 1, s.first_order)
        logs = stream.log_probabilities(models.text, models.totals[0], [order, ORDER, ORDER, ORDER])
        for k in range(len(CLASSES)):
            ratio = np.maximum(logs[:, k + 1] - logs[:, 0], s.floor)
            least, cover = (s.first_ratio, s.first_coverage[k]) if models.first else (s.ratio, s.coverage)
            share, gain, _ = covered(stream, ratio, s.width, least)
            found = (share >= cover) & (gain >= s.evidence) & (gain > best)
            kind[found], best[found] = k, gain[found]
            doubt |= (share >= cover * s.pool) & (gain >= s.evidence * s.pool)
            beside[(kind < 0) & (share >= s.beside[0]) & (gain >= s.beside[1])] = k
    shapes = laid.shapes()
    marked = np.zeros(len(texts), bool)
    if shapes.place.size:
        logs = shapes.log_probabilities(models.shape, models.totals[1], [s.first_order if models.first else ORDER, ORDER])
        ratio = np.maximum(logs[:, 1] - logs[:, 0], s.shape_floor)
        # a word beside a marker may be any: it counts only if prose knows the pair from elsewhere
        at = np.flatnonzero((shapes.codes[shapes.source] >= BESIDE) & (shapes.codes[shapes.source] < BESIDE + BESIDES))
        if len(at):
            pair, marker = (models.shape[shapes.grams[n][shapes.place[at] - 1 + n], 0] for n in (1, 0))
            known = np.maximum(pair - 2, 0) / np.maximum(marker, 1)
            ratio[at] = -np.log(1 + s.pair * np.minimum(known, 1.0))
        # a text with placeholders is otherwise prose: each mark is drawn from either model
        share, _, _ = covered(shapes, np.log(0.5 + 0.5 * np.exp(np.minimum(ratio, 50.0))), s.shape_width, s.shape_ratio)
        sums = np.concatenate([[0.0], np.cumsum(ratio, dtype=np.float64)])
        first = np.cumsum(shapes.end - shapes.start) - (shapes.end - shapes.start)
        for i in np.flatnonzero(share > 0):
            marked[i] = any(sums[first[i] + m.end()] - sums[first[i] + m.start()] >= s.shape_evidence for m in FORM.finditer(shapes.text(i)))
    return Verdict(stream, owner, kind, doubt, beside, shapes, marked)


def _blocks(texts: list[str | None], most: int = BLOCK):
    """(places, texts) of about ``most`` characters, empty ones left out; a longer text comes in several parts, cut at spaces where it has any."""
    places, part, size = [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while t and at < len(t):
            stop = min(len(t), at + most)
            if stop < len(t) and (gap := t.rfind(" ", at + most // 2, stop)) > 0:
                stop = gap + 1
            places.append(i)
            part.append(t[at:stop])
            size += stop - at
            at = stop
            if size >= most:
                yield np.array(places), part
                places, part, size = [], [], 0
    if part:
        yield np.array(places), part


def _sums(docs: DataFrame, work, names: list[str], sent=None) -> dict[str, np.ndarray]:
    """Counts by bucket that ``work(texts, sums, models)`` adds up over all documents; sent: the models, packed and broadcast.

    Tasks are as many as cores, whatever the number of files, and a task returns at most one number for each bucket; the driver gathers no more than that.
    """
    size = {n: SHAPES if n.startswith("shape") else BUCKETS for n in names}
    offset = dict(zip(names, np.cumsum([0, *[size[n] for n in names]]).tolist()))

    def run(batches):
        sums, models = {n: np.zeros(size[n]) for n in names}, None
        for batch in batches:
            if models is None and sent is not None:
                models = Models.unpacked(sent.value)
            for _, part in _blocks(batch.column(0).to_pylist(), BLOCK if models else 4 * BLOCK):
                work(part, sums, models)
        for n in names:
            at = np.flatnonzero(sums[n])
            for a in range(0, len(at), 200_000):
                part = at[a : a + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(part + offset[n], pa.int64()), pa.array(sums[n][part], pa.float64())], names=["bucket", "n"])

    few = docs.coalesce(docs.sparkSession.sparkContext.defaultParallelism)
    got = few.mapInArrow(run, "bucket bigint, n double").groupBy("bucket").agg(F.sum("n").cast("float").alias("n")).toArrow()
    values = np.zeros(sum(size.values()))
    values[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return {n: values[offset[n] : offset[n] + size[n]] for n in names}


def _models(prose: np.ndarray, shape: np.ndarray, filler, notice, marks, first: bool) -> Models:
    seeds = seed_counts()
    text = np.stack([np.maximum(prose, 0), seeds[0] + filler, seeds[1] + notice, np.zeros(BUCKETS)], axis=1)
    return Models(np.ascontiguousarray(text, np.float32), np.ascontiguousarray(np.stack([np.maximum(shape, 0), seeds[2] + marks], axis=1), np.float32), first)


def fit(docs: DataFrame, text: str = "text", rounds: int = 5, settings: Settings = Settings()) -> Models:
    """Fit the prose models to all texts and the residue models to seeds and what is found.

    One pass counts the n-grams of all texts. The corpus itself holds residue, so the first prose model, which looks back
    one character at most, serves to find the surest of it, and with thresholds multiplied by ``settings.pool`` all that
    may be residue; those texts are kept and looked at again in each round: what the last models take for residue
    joins the seeds of its class, a doubtful piece beside a sure one too, and is taken from the counts of prose.
    """
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("text")).filter(F.length("text") > 0)
    spark = docs.sparkSession

    def everything(part, sums, _):
        laid = Laid(part)
        laid.pieces()[0].count(sums["prose"])
        laid.shapes().count(sums["shape"])

    whole = _sums(texts, everything, ["prose", "shape"])
    models = _models(whole["prose"], whole["shape"], 0.0, 0.0, 0.0, True)
    shared = spark.sparkContext.broadcast(models.packed())

    def doubtful(batches):
        now = Models.unpacked(shared.value)
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            for places, part in _blocks(batch.column(0).to_pylist()):
                v = judge(part, now, settings)
                kept[places[v.owner[v.pool]]] = True
                kept[places[v.marked]] = True
            if kept.any():
                yield batch.filter(pa.array(kept))

    pool = cut_lineage(texts.mapInArrow(doubtful, "text string"))
    shared.destroy()
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(models.packed())

        def learn(part, sums, now):
            v = judge(part, now, settings)
            for k, name in enumerate(CLASSES):
                sure = np.zeros(len(part), bool)
                sure[v.owner[v.kind == k]] = True
                take = (v.kind == k) | ((v.beside == k) & sure[v.owner])
                if take.any():
                    v.stream.count(sums[name], take)
            if v.marked.any():
                v.shapes.count(sums["shape"], v.marked)

        found = _sums(pool, learn, [*CLASSES, "shape"], sent)
        sent.destroy()
        models = _models(whole["prose"] - found["filler"] - found["notice"], whole["shape"] - found["shape"], found["filler"], found["notice"], 0.0, False)
    return models


def find(docs: DataFrame, models: Models, text: str = "text", keep: list[str] | None = None, settings: Settings = Settings()) -> DataFrame:
    """The kept columns of every document, and ``residue``: the classes found, an empty list for a clean one; ``residue_share``: the share of its characters in pieces of residue.

    A document has filler or notice if a piece of it is covered by windows in which that class is likelier
    than prose; a placeholder if the marks of a window are and a full placeholder stands in the text. Null, empty
    and blank texts are clean, with share 0; repeated rows are judged alike; texts of any length are judged
    whole. A kept column of the same name pushes the new one to a trailing underscore. No shuffle.
    """
    keep = list(docs.columns if keep is None else keep)
    names = [free_name(keep, "residue"), free_name(keep, "residue_share")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(f"`{text}`").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(models.packed())

    def run(batches):
        now = Models.unpacked(shared.value)
        for batch in batches:
            n = batch.num_rows
            has = np.zeros((n, len(CLASSES) + 1), bool)
            whole, inside = np.zeros(n), np.zeros(n)
            for places, part in _blocks(batch.column(1).to_pylist()):
                v = judge(part, now, settings)
                length = v.stream.end - v.stream.start
                owner = places[v.owner] if len(v.owner) else v.owner
                whole += np.bincount(owner, length, n)
                inside += np.bincount(owner, length * (v.kind >= 0), n)
                for k in range(len(CLASSES)):
                    has[owner[v.kind == k], k] = True
                has[places[v.marked], -1] = True
            found = [[c for c, on in zip((*CLASSES, "placeholder"), row) if on] if row.any() else [] for row in has]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string())), pa.array(inside / np.maximum(whole, 1), pa.float64())], names=["kept", "residue", "share"])

    schema = T.StructType([packed.schema["kept"], T.StructField("residue", T.ArrayType(T.StringType())), T.StructField("share", T.DoubleType())])
    out = packed.mapInArrow(run, schema)
    return out.select(*[F.col(f"kept.`{c}`").alias(c) for c in keep], F.col("residue").alias(names[0]), F.col("share").alias(names[1]))
