"""Abusive, hateful or sexual content (problem 10): maximum-scoring segment search.

Every token gets a score: the log-odds of an abusive against a harmless passage, each estimated
with an informative Dirichlet prior whose shape is the token's frequency in all documents. The
score of a token also holds the log-odds of the pair it forms with the token before. A linear
scan (Ruzzo and Tompa) finds all maximal passages of a document, and an extreme-value law turns
a passage's score into the number of such passages to expect by chance in the stretch of text
around it (Karlin and Altschul).

Spelling is undone token by token and only once per distinct token: letter case, accents,
look-alike letters, invisible characters, digits for letters, stretched letters, letters set
apart, words broken at line ends, stars for letters, and single slips of the pen.

Three passes over documents: counts of the sample's tokens in all documents (one bounded table
of counts), the scan, and the report.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import abuse_sample
from framewright.llm.mixing import source_name

PRIOR = 40.0  # Dirichlet mass that is spread as the tokens of all documents are
PAIR_PRIOR = 5.0
CORPUS = 20_000.0  # tokens that all documents together weigh on the harmless side
HARMLESS = 3  # times that a harmless passage counts, as documents outweigh them
CHANCE = 0.05  # expected passages by chance up to which a passage counts
SHORT = 200  # tokens added to each text: the law holds for long ones
STRETCH = 200  # tokens around a passage that it is judged against, so that the length of the document doesn't matter
SHUFFLES = 4_000  # shuffled stretches that K is fitted to
SMOOTHING = 0.1  # share of the harmless passages in what counts as chance
DOUBT = 6.0  # abusive uses that each possible slip and each word of LEXICON is credited with
USED = 0.3  # share of abusive uses from which on a possible slip is one
PLAIN = 2.0  # most that one word outside the insults adds
BESIDE = 3  # words on each side that tell whether a frequent word is a slip
CACHE = 400_000  # distinct tokens a worker remembers

_PIECE = re.compile(r"(?:[^\W_]|[*#@$]|!(?=[^\W_]))+")
_APART = re.compile(r"(?<!\S)[^\W\d_](?:(?: [.*_-])? [^\W\d_]){2,}(?![^\W_])")
_MAYBE_APART = re.compile(r" \w(?: [.*_-])? \w(?: [.*_-])? \w\b")
_CODE = re.compile(r"\d{4,}")
_LETTER = re.compile(r"[^\W\d_]")
_STRETCH = re.compile(r"(.)\1+")
_MASK = re.compile(r"[^\W_][*#]+(?:[^\W_]|(?<=[*#])[*#])*[^\W_]")
# Letters that look like Latin ones, digits written for letters, joined letters.
_LOOKALIKE = str.maketrans(
    "абвгеєзікмнорстухѕјԁԛԝһӏαβγεικνορτυχ",
    "abbreezikmhopctyxsjdqwhlabyeiknoptux",
)
_LETTERS = {
    "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d",
    "أ": "ا", "إ": "ا", "آ": "ا", "ى": "ي", "ة": "ه", "ـ": "",
}
_LETTER_TABLE = str.maketrans(_LETTERS)
_DIGITS = str.maketrans("01345678@$!9", "oieasgtbasig")
_CLITICS = ("وال", "ال", "و", "ف", "ب", "ل")  # Arabic words that are written together with the next one
_OTHER_READINGS = (("1", "l"), ("v", "u"))  # letters that a sign may stand for besides
SLIP_MARK = "~"
DOUBTED = "~<"  # first signs of symbols whose neighbours are counted
SLIP = 5  # shortest word that may hold a slip of the pen


def folded(token: str) -> str:
    """A lower-case token without accents, invisible characters and look-alike letters."""
    if token.isascii():
        return token
    plain = unicodedata.normalize("NFKD", token.translate(_LETTER_TABLE))
    plain = "".join(c for c in plain if unicodedata.category(c) not in ("Mn", "Cf"))
    return plain.lower().translate(_LOOKALIKE).translate(_LETTER_TABLE)


def skeleton(token: str) -> str:
    """What is compared: folded, digits read as letters, stretched letters shortened."""
    plain = folded(token)
    if not plain.isalpha() and any(c.isalpha() for c in plain):
        plain = plain.translate(_DIGITS)
        plain = "".join(c for c in plain if c.isalnum())
    return _STRETCH.sub(r"\1", plain)


def tokens_of(text: str) -> list[str]:
    """Lower-cased text cut at white space; letters set apart are joined, broken words too."""
    text = text.lower()
    if "-\n" in text:
        text = text.replace("-\n", "")
    tokens = text.split()
    spaced = " ".join(tokens)
    if _MAYBE_APART.search(spaced):
        tokens = _APART.sub(lambda m: "".join(c for c in m[0] if c.isalpha()), spaced).split(" ")
    return tokens


def pieces_of(token: str) -> list[str]:
    """The words inside a token, folded; letters with a sign between each are one word."""
    pieces = _PIECE.findall(folded(token))
    if len(pieces) > 2 and all(len(x) == 1 for x in pieces):
        return ["".join(pieces)]
    return pieces


def _near(word: str) -> set[str]:
    """The word and the word less one letter, for comparing words one slip apart."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


@dataclass
class Lexicon:
    """Symbols of the sample's tokens: `<class>word` for words of LEXICON, else the word itself."""

    symbols: dict[str, str] = field(default_factory=dict)
    masked: dict[tuple[str, str, int], str] = field(default_factory=dict)
    slips: dict[str, set[tuple[str, str]]] = field(default_factory=lambda: defaultdict(set))

    swaps: dict[str, set[tuple[str, str]]] = field(default_factory=lambda: defaultdict(set))

    @classmethod
    def build(cls) -> Lexicon:
        out = cls()
        classes: dict[str, str] = {}
        for name, words in abuse_sample.LEXICON.items():
            for w in words.split():
                classes.setdefault(skeleton(w), f"<{name}>")
        spelt: dict[str, str] = {}
        abusive: set[str] = set()
        for text, bad in ((abuse_sample.ABUSIVE, True), (abuse_sample.HARMLESS, False)):
            for line in abuse_sample.passages(text):
                for w in (x for t in tokens_of(line) for x in pieces_of(t)):
                    s = skeleton(w)
                    out.symbols[s] = classes[s] + s if s in classes else s
                    spelt.setdefault(w, s)
                    if bad:
                        abusive.add(s)
        for words in abuse_sample.LEXICON.values():
            for w in words.split():
                s = skeleton(w)
                out.symbols.setdefault(s, classes[s] + s)
                spelt.setdefault(folded(w), s)
                abusive.add(s)
        for word, s in sorted(spelt.items()):
            if s in abusive and len(word) >= 3:
                # classes before plain words, so that a masked word is read as the worse one
                key = (word[0], word[-1], len(word))
                if key not in out.masked or out.symbols[s].startswith("<"):
                    out.masked[key] = out.symbols[s]
            if s in abusive:
                for form in {s, word}:
                    if len(form) == SLIP - 1 and out.symbols[s].startswith("<"):
                        out.swaps["".join(sorted(form))].add((form, out.symbols[s]))
                    if len(form) >= SLIP and form.isalpha() and out.symbols[s].startswith("<"):
                        for x in _near(form):
                            out.slips[x].add((form, out.symbols[s]))
        return out

    def read(self, token: str) -> tuple[str | None, str | None]:
        """For a folded word: (symbol or None, its skeleton if it only may be a slip, or None)."""
        if token.isdigit():
            return None, None
        if "*" in token or "#" in token:
            bare = token.strip("*#")
            if _MASK.fullmatch(bare):
                return self.masked.get((bare[0], bare[-1], len(bare)), "<masked>"), None
        s = skeleton(token)
        symbol = self.symbols.get(s)
        if symbol is None and s[:1] in "والفبل":
            for joined in _CLITICS:
                if s.startswith(joined) and len(s) >= len(joined) + 3:
                    symbol = symbol or self.symbols.get(s[len(joined) :])
        if symbol is None:
            for sign, letter in _OTHER_READINGS:
                if sign in token:
                    symbol = self.symbols.get(skeleton(token.replace(sign, letter)))
                    if symbol is not None and symbol[0] == "<":
                        return symbol, None
                    symbol = None
        if symbol is not None:
            return symbol, None
        if 2 * sum(map(str.isdigit, token)) > len(token):
            return None, None  # a code: read exactly or not at all
        for form in dict.fromkeys((s, token)):
            if len(form) == SLIP - 1:  # short words: two neighbours swapped
                for word, symbol in self.swaps.get("".join(sorted(form)), ()):
                    if word[0] == form[0] and _one_slip(word, form):
                        return symbol, s
            if len(form) < SLIP or not form.isalpha():
                continue
            for x in _near(form):
                for word, symbol in self.slips.get(x, ()):
                    # one letter more, less or other, or two neighbours swapped
                    if abs(len(word) - len(form)) <= 1 and (word[0] == form[0] or len(form) > 7) and _one_slip(word, form):
                        return symbol, s
        return None, None


def _one_slip(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])


def kind_of(symbol: str) -> str:
    """What pairs and the sample's counts see: the class of a word of LEXICON, else the word itself."""
    return symbol[: symbol.index(">") + 1] if symbol[:1] == "<" else symbol


@lru_cache(maxsize=1)
def lexicon() -> Lexicon:
    """The sample's lexicon, built once per process."""
    return Lexicon.build()


class Reader(dict):
    """Turns texts into symbols, remembering what each distinct token stands for.

    As a dict: token -> symbol or None, for tokens of one word. Tokens of several words are in
    `several`, if the sample knows one of them. `common` has the words that only look like slips of the pen; while it is not known
    (None), a possible slip is read as SLIP_MARK and its skeleton.
    """

    def __init__(self, common: frozenset[str] | None = None):
        super().__init__()
        self.common = common
        self.several: dict[str, tuple[list[str], list[str | None]]] = {}

    def __missing__(self, token: str) -> str | None:
        raw = token
        if _CODE.search(token) and len(_LETTER.findall(_CODE.sub("", token))) <= 3:
            return None  # numbers, times and codes are many and not worth remembering
        if not _LETTER.search(token):
            return None
        if "(" in token[:-1] and ")" not in token and _LETTER.search(token, token.index("(")):
            whole = token.replace("(", "c")  # a bracket for a letter, if that gives a known word
            if any((lexicon().read(x)[0] or "")[:1] == "<" for x in pieces_of(whole)):
                token = whole
        pieces = pieces_of(token)
        symbols = []
        for piece in pieces:
            symbol, slip = lexicon().read(piece)
            if slip is not None and self.common is None:
                symbol = SLIP_MARK + slip
            elif slip is not None and slip in self.common:
                symbol = None
            symbols.append(symbol)
        if len(pieces) > 1 and any(symbols):
            self.several[raw] = (pieces, symbols)
            symbol = None
        else:
            symbol = symbols[0] if symbols else None
        self[raw] = symbol
        return symbol

    def symbols(self, text: str) -> tuple[list[str], list[str | None]]:
        """Words (tokens, cut where they hold several) and their symbols."""
        if len(self) > CACHE:
            self.clear()
            self.several.clear()
        tokens = tokens_of(text)
        symbols = list(map(self.__getitem__, tokens))
        if self.several.keys().isdisjoint(tokens):
            return tokens, symbols
        words: list[str] = []
        read: list[str | None] = []
        several = self.several
        for token, symbol in zip(tokens, symbols, strict=True):
            if token in several:
                words += several[token][0]
                read += several[token][1]
            else:
                words.append(token)
                read.append(symbol)
        return words, read


def corpus_counts(documents: DataFrame) -> DataFrame:
    """(kind, a, b, n): how often the sample's symbols, pairs and possible slips occur in the distinct texts.

    kind is `token`, `pair` (of kinds), `all` (number of tokens), `at` (places of a possible slip or a word of LEXICON)
    or `beside` (symbols near those). The table is bounded by the sample: its symbols, pairs of them,
    and the words one slip away from its words.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, pairs_of, kinds = Reader(), set(sample_pairs()), {None: None}
        single, double, total = Counter(), Counter(), 0
        places, beside = Counter(), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                raw, symbols = reader.symbols(text)
                total += len(raw)
                here = Counter(symbols)
                single.update(here)
                for x in here.keys() - kinds.keys():
                    kinds[x] = kind_of(x)
                double.update(p for p in pairwise(map(kinds.__getitem__, symbols)) if p in pairs_of)
                if any(s and s[0] in DOUBTED for s in here):
                    at, near = doubted_places(symbols)
                    places.update(at)
                    beside.update(near)
        rows = [("all", "", "", total)]
        rows += [("token", s, "", n) for s, n in single.items() if s is not None and s[0] != SLIP_MARK]
        rows += [("at", s, "", n) for s, n in places.items()]
        rows += [("beside", s, x, n) for (s, x), n in beside.items()]
        rows += [("pair", a, b, n) for (a, b), n in double.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("kind", "a", "b", "n"), r, strict=True)) for r in rows])

    # a text counts once: copies of an abusive text must not make its words look harmless
    texts = documents.where("text <> ''").select("text").distinct()
    counted = texts.mapInArrow(count, "kind string, a string, b string, n long")
    return counted.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def doubted_places(symbols: list[str | None]) -> tuple[Counter, Counter]:
    """Places of each possible slip and word of LEXICON in a text, and how often each symbol (empty: unknown) stands near it."""
    places, beside = Counter(), Counter()
    for i, s in enumerate(symbols):
        if s and s[0] in DOUBTED:
            places[s] += 1
            for x in (*symbols[max(0, i - BESIDE) : i], *symbols[i + 1 : i + 1 + BESIDE]):
                if x is None or x[0] != SLIP_MARK:  # a possible slip tells nothing
                    beside[s, x or ""] += 1
    return places, beside


def _uses(counts: list[tuple[str, str, str, int]], token: dict, unknown: float, among: float) -> dict[str, float]:
    """Share of the uses of each possible slip and word of LEXICON, over all documents, that stand among abusive words.

    Read off the mean score of the words near it: 0 where all of them are unknown, 1 where they score as near the
    words of LEXICON in the abusive passages (`among`). Being frequent is no evidence, as an insult may be used or
    misspelt by many. DOUBT abusive uses are added, so that it takes several harmless places to doubt a word.
    """
    places = {a: n for kind, a, _, n in counts if kind == "at"}
    near: dict[str, float] = defaultdict(float)
    for kind, a, b, n in counts:
        if kind == "beside":
            near[a] += n * token.get(b, unknown)
    low = 2 * BESIDE * unknown
    out = {}
    for a, n in places.items():
        share = min(1.0, max(0.0, (near[a] / n - low) / max(among - low, 1e-9)))
        out[a] = (share * n + DOUBT) / (n + DOUBT)
    return out


def sample_symbols(text: str) -> list[list[str]]:
    """The kinds of the symbols of each passage; empty: unknown."""
    reader = Reader()
    return [[kind_of(s) if s else "" for s in reader.symbols(line)[1]] for line in abuse_sample.passages(text)]


def sample_pairs() -> Counter:
    both = sample_symbols(abuse_sample.ABUSIVE) + sample_symbols(abuse_sample.HARMLESS)
    return Counter(p for line in both for p in pairwise(line))


@dataclass
class Scores:
    """What the scan needs; its size follows the sample, not the documents."""

    token: dict[str, float]
    pair: dict[tuple[str, str], float]
    unseen_pair: float  # of two known symbols that the sample never has side by side
    unknown: float  # of a token outside the sample
    decay: float  # lambda of the extreme-value law, pairs included
    scale: float  # K of the law, fitted to shuffled text
    common: frozenset[str]
    kinds: dict[str, str] = field(default_factory=dict)  # symbol -> kind, where they differ

    def expected(self, score: float, tokens: int) -> float:
        """Passages of at least this score that chance brings in so many tokens."""
        return self.scale * (tokens + SHORT) * math.exp(-self.decay * score)


def _log_odds(bad: Counter, good: Counter, share: dict, mass: float, least: float) -> dict:
    """Log-odds with Dirichlet priors of total mass `mass`, shaped as `share`."""
    total_bad, total_good = sum(bad.values()) + mass, sum(good.values()) + mass
    out = {}
    for x in {*bad, *good}:
        prior = mass * max(share.get(x, 0.0), least)
        p, q = bad[x] + prior, good[x] + prior
        out[x] = math.log(p / max(total_bad - p, 1e-9)) - math.log(q / max(total_good - q, 1e-9))
    return out


def fit(counts: list[tuple[str, str, str, int]]) -> Scores:
    """Scores from the sample and the counts of `corpus_counts`."""
    words = Counter({a: n for kind, a, _, n in counts if kind == "token"})
    single: Counter = Counter()
    for s, n in words.items():
        single[kind_of(s)] += n
    double = Counter({(a, b): n for kind, a, b, n in counts if kind == "pair"})
    total = max(1, sum(n for kind, _, _, n in counts if kind == "all"))
    bad = sample_symbols(abuse_sample.ABUSIVE)
    good = sample_symbols(abuse_sample.HARMLESS)
    weight = CORPUS / total
    bad_one = Counter(s for line in bad for s in line if s)
    good_one = Counter({s: HARMLESS * n for s, n in Counter(s for line in good for s in line if s).items()})
    for s, n in single.items():
        good_one[s] += n * weight
    bad_one["<masked>"] += 4
    for s in map(kind_of, lexicon().symbols.values()):  # classes that no passage has
        bad_one.setdefault(s, 0)
    share = {s: n / total for s, n in single.items()}
    token = _log_odds(bad_one, good_one, share, PRIOR, 1e-4)
    # only an insult is abuse by itself; other words have to come together
    token = {s: x if s in ("<insult>", "<masked>") else min(x, PLAIN) for s, x in token.items()}
    bad_two = Counter(p for line in bad for p in pairwise(line))
    good_two = Counter({p: HARMLESS * n for p, n in Counter(p for line in good for p in pairwise(line)).items()})
    for p, n in double.items():
        good_two[p] += n * weight
    pair_share = {p: n / total for p, n in double.items()}
    pair = _log_odds(bad_two, good_two, pair_share, PAIR_PRIOR, 1e-3)
    # a pair adds only what its second token has not told already
    pair = {p: min(2.5, max(-3.0, 0.5 * x)) for p, x in pair.items()}
    unknown = -math.log(1 + sum(bad_one.values()) / PRIOR) / 2
    unseen = -0.5
    value = token | {s: token[kind_of(s)] for s in {*lexicon().symbols.values(), *words} if kind_of(s) in token}
    # a passage stands in unknown text
    padded = [[""] * BESIDE + line + [""] * BESIDE for line in bad]
    around = [
        sum(value.get(x, unknown) for x in (*line[i - BESIDE : i], *line[i + 1 : i + 1 + BESIDE]))
        for line in padded for i, s in enumerate(line) if s[:1] == "<"
    ]
    uses = _uses(counts, value, unknown, sum(around) / max(len(around), 1))
    common = frozenset(s[1:] for s, x in uses.items() if s[0] == SLIP_MARK and x < USED)
    token = {s: x + math.log(uses.get(s, 1.0)) if s[:1] == "<" else x for s, x in value.items()}
    harmless = Counter(s for line in good for s in line)
    decay, scale = _extreme_value(words, total, harmless, token, pair, unseen, unknown)
    kinds = {s: kind_of(s) for s in token if kind_of(s) != s}
    return Scores(token, pair, unseen, unknown, decay, scale, common, kinds)


def _extreme_value(
    single: Counter, total: int, harmless: Counter, token: dict, pair: dict, unseen: float, unknown: float
) -> tuple[float, float]:
    """lambda and K of the law for shuffled text: all documents' tokens in random order, as the scan scores them.

    Scores depend on the token before, too, so lambda is the value at which the matrix p_j * exp(lambda * score_ij)
    has a leading eigenvalue of 1 (the law for scores along a Markov chain). K is the maximum-likelihood
    fit to the best passages of SHUFFLES shuffled stretches. Chance draws from the counts of all documents and, in
    SMOOTHING of the draws, from the harmless passages, so that words that look abusive are always among them.
    """
    known = sum(single.values())
    kinds = sorted({*single, *harmless} - {""})
    place = {s: i + 1 for i, s in enumerate(kinds)}  # 0 is any token outside the sample
    corpus = np.array([max(total - known, 1), *[single[s] for s in kinds]], dtype=float)
    sample = np.array([harmless[""], *[harmless[s] for s in kinds]], dtype=float)
    p = (1 - SMOOTHING) * corpus / corpus.sum() + SMOOTHING * sample / max(sample.sum(), 1)
    scores = np.array([unknown, *[token.get(s, unknown) for s in kinds]])
    both = np.full((len(p), len(p)), unseen) + scores[None, :]
    of = defaultdict(list)
    for s, i in place.items():
        of[kind_of(s)].append(i)
    for (a, b), x in pair.items():
        for i in of.get(a, ()):
            both[i, of.get(b, [])] = scores[of.get(b, [])] + x
    both[0, :] = scores  # after an unknown token there is no pair
    both[:, 0] = unknown

    def leading(decay: float) -> float:
        step = p[None, :] * np.exp(decay * both)
        v, most = np.ones(len(p)), 1.0
        for _ in range(40):
            v = step @ v
            most = v.max()
            v /= most
        return most

    low, high = 1e-3, 5.0
    for _ in range(30):
        mid = (low + high) / 2
        low, high = (mid, high) if leading(mid) < 1 else (low, mid)
    drawn = np.random.default_rng(10).choice(len(p), size=(SHUFFLES, STRETCH), p=p)
    best = run = np.zeros(SHUFFLES)
    for i in range(STRETCH):
        x = scores[drawn[:, 0]] if i == 0 else both[drawn[:, i - 1], drawn[:, i]]
        run = np.maximum(run + x, 0.0)
        best = np.maximum(best, run)
    return low, SHUFFLES / ((STRETCH + SHORT) * float(np.exp(-low * best).sum()))


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score), by the linear-time scan of Ruzzo and Tompa."""
    total = 0.0
    left: list[float] = []
    right: list[float] = []
    span: list[list[int]] = []
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        l, r, at = before, total, [i, i]
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= l:
                j -= 1
            if j < 0 or right[j] >= r:
                left.append(l), right.append(r), span.append(at)
                break
            l, at = left[j], [span[j][0], i]
            del left[j:], right[j:], span[j:]
    return [(a, b, r - l) for (a, b), l, r in zip(span, left, right, strict=True)]


def scan(reader: Reader, scores: Scores, text: str) -> tuple[int, list[tuple[float, float, str]]]:
    """(tokens, passages as (score, expected by chance, words)), best first."""
    raw, symbols = reader.symbols(text)
    values: list[float] = []
    place: list[int] = []
    last, before = -1, None
    token, pair, unseen, unknown = scores.token, scores.pair, scores.unseen_pair, scores.unknown
    kinds = scores.kinds
    for i, s in enumerate(symbols):
        if s is None:
            continue
        gap = i - last - 1
        if gap:
            values.append(gap * unknown)
            place.append(i - 1)
            before = None
        x, kind = token.get(s, unknown), kinds.get(s, s)
        if before is not None:
            x += pair.get((before, kind), unseen)
        values.append(x)
        place.append(i)
        last, before = i, kind
    found = []
    for a, b, score in maximal_segments(values):
        expected = scores.expected(score, min(len(raw), STRETCH))
        if expected <= CHANCE:
            found.append((score, expected, " ".join(raw[place[a] : place[b] + 1])))
    return len(raw), sorted(found, key=lambda x: x[1])


def abuse_scores(documents: DataFrame) -> DataFrame:
    """(doc_id, source, score, passages, worst): one row per document.

    score is -log10 of the number of passages like the document's significant ones that chance
    would bring in a stretch of text (0: none is significant), passages their number, worst the words of the
    strongest one (NULL: none). Identical rows count once; NULL and empty texts score 0. source
    is in normal spelling.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", "source", "text")
    counts = [tuple(r) for r in corpus_counts(rows).collect()]  # bounded by the sample
    sent = spark.sparkContext.broadcast(fit(counts))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = sent.value
        reader = Reader(scores.common)
        for batch in batches:
            score, passages, worst = [], [], []
            for text in batch.column("text").to_pylist():
                found = scan(reader, scores, text)[1] if text else []
                score.append(-sum(math.log10(max(x[1], 1e-300)) for x in found))
                passages.append(len(found))
                worst.append(found[0][2] if found else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(score, "double"), pa.array(passages, "int64"), pa.array(worst, "string")],
                names=["doc_id", "source", "score", "passages", "worst"],
            )

    judged = rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("source"), "text"
    ).mapInArrow(judge, "doc_id long, source string, score double, passages long, worst string")
    return judged.distinct()


def found_documents(scored: DataFrame) -> DataFrame:
    """(doc_id) of the documents with a significant passage."""
    return scored.where("passages > 0").select("doc_id").distinct()


def abuse_rates(scored: DataFrame) -> DataFrame:
    """Documents, abusive documents and their rate per source."""
    return scored.groupBy("source").agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("passages") > 0).alias("abusive"),
        F.avg((F.col("passages") > 0).cast("double")).alias("rate"),
    )
