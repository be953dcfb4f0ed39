import random

import pytest

from framewright.llm import abuse as A
from framewright.llm import abuse_sample as S

DOC = "doc_id long, text string, source string, score double, worst string"
FILLER = "the reviewer compared the upload with the earlier picture and the case was closed . ".split()


@pytest.fixture(scope="module")
def scores():
    r = random.Random(1)
    texts = [" ".join(r.choices(FILLER, k=60)) for _ in range(200)]
    return A.fit(_counts(texts))


def _counts(texts):
    from collections import Counter
    from itertools import pairwise

    reader, pairs = A.Reader(), set(A.sample_pairs())
    counts = Counter()
    for t in texts:
        words, symbols = reader.symbols(t)
        counts["all", "", ""] += len(words)
        counts.update(("token", s, "") for s in symbols if s and s[0] != A.SLIP_MARK)
        counts.update(("pair", *p) for p in pairwise(A.kind_of(s) if s else None for s in symbols) if p in pairs)
        at, near = A.doubted_places(symbols)
        for s, n in at.items():
            counts["at", s, ""] += n
        for k, n in near.items():
            counts["beside", *k] += n
    return [(*k, n) for k, n in counts.items()]


def passages(scores, text):
    around = " ".join(FILLER)
    return A.scan(A.Reader(scores.common), scores, f"{around} {text} {around}")[1]


ABUSIVE = [
    "You are a filthy bastard and everyone here knows it!",
    "YOU ARE A WORTHLESS MORON",
    "you are a s.t.u.p.i.d i d i o t and everyone knows it",
    "Go f-u-c-k yourself, you lazy b!tch",
    "go f*ck yourself you lazy b*#*h",
    "yоu аrе а filthy bаstаrd",  # letters of another script
    "You are a fil​thy bas­tard",
    "you are a useleess idiiiiiot",
    "I will k1ll y0u, you b@574rd",
    "you are a filthy bas-\ntard",
    "Ferme ta gueule, sale órdüre",
    "Va te faire foutre, toi et ta famille",
    "Vete a la mierda, hijo de puta",
    "Halt die Fresse, du Arschloch",
    "Pass auf, ich werde dich umbringen!",
    "Siktir git, aptal",
    "اخرس يا ح_م_ا_ر",
    "سوف أقتلك عندما تخرج من هنا",
    'The caller wrote: "they breed like rats and the only cure is fire"',
    "show me your tits on the next call",
]
HARMLESS = [
    "This damn scanner is slow as hell and crashed again.",
    "Please kill the hanging process before it dies again.",
    "Dead pixels and a naked cable made the camera useless.",
    "The patient was treated for breast cancer.",
    "Messages with insults or threats go to the desk lead.",
    "Quelle merde cette imprimante.",
    "Qué mierda de escáner, se atascó otra vez.",
    "Your service was terrible and I will file a complaint.",
    "Mrs. Titmarch of Scunwick came to the office.",
    "The stupid form lost my number again.",
    "",
]


@pytest.mark.parametrize("text", ABUSIVE)
def test_abusive(scores, text):
    assert passages(scores, text)


@pytest.mark.parametrize("text", HARMLESS)
def test_harmless(scores, text):
    assert not passages(scores, text)


def brute_segments(values):
    """Maximal segments by their definition: the best segment, then the same to its left and right."""
    best = None
    for i in range(len(values)):
        total = 0
        for j in range(i, len(values)):
            total += values[j]
            if total > 0 and (best is None or total > best[2]):
                best = (i, j, total)
    if best is None:
        return []
    i, j, s = best
    right = [(a + j + 1, b + j + 1, t) for a, b, t in brute_segments(values[j + 1 :])]
    return [*brute_segments(values[:i]), (i, j, s), *right]


def test_linear_scan_is_exact():
    r = random.Random(3)
    for _ in range(300):
        values = [r.uniform(-2, 1.5) for _ in range(r.randint(0, 40))]
        got = A.maximal_segments(values)
        want = brute_segments(values)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_extreme_value_law(scores):
    assert scores.decay > 0
    assert scores.expected(10, 100) < scores.expected(5, 100) < scores.expected(5, 1000)


def test_documents(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choices(FILLER, k=50)), "Review-Note", 0.0, "c") for i in range(60)]
    rows += [(100 + i, " ".join(FILLER) + " " + t, " review note", 0.0, "c") for i, t in enumerate(ABUSIVE)]
    rows += [(200, None, None, 0.0, "c"), (None, "a page", "x", 0.0, "c"), (2**62 + 1, "a page", "x", 0.0, "c"), (201, "", "x", 0.0, "c"), (202, "you are a filthy idiot " + "page of the card " * 60_000, "x", 0.0, "c")]
    rows += rows[:5]
    df = spark.createDataFrame(rows, DOC)
    scored = A.abuse_scores(df)
    assert scored.count() == len({x[0] for x in rows})
    assert {x["doc_id"] for x in A.found_documents(scored).collect()} == {100 + i for i in range(len(ABUSIVE))} | {202}
    rates = {x["source"]: (x["documents"], x["abusive"]) for x in A.abuse_rates(scored).collect()}
    assert rates == {"review_note": (60 + len(ABUSIVE), len(ABUSIVE)), None: (1, 0), "x": (4, 1)}
    assert A.abuse_scores(df.limit(0)).count() == 0


def test_frequent_slips_stay_slips(spark):
    r = random.Random(7)
    around = lambda n: " ".join(r.choices(FILLER, k=n))
    insult = "you are a filthy bsatard and a wortlhess idiot"
    rows = [(i, f"{around(20)} {insult} {around(20)}" if i < 100 else f"{around(30)} a strange screen {around(20)}", "x", 0.0, "c") for i in range(400)]
    rows += [(1000 + i, "the clerk called him a bsatard", "x", 0.0, "c") for i in range(200)]  # copies
    counts = [tuple(x) for x in A.corpus_counts(spark.createDataFrame(rows, DOC)).collect()]
    places = {a: n for kind, a, _, n in counts if kind == "at"}
    assert places["~bsatard"] == 101 and places["~strange"] == 300  # copies count once
    common = A.fit(counts).common
    assert "strange" in common and not {"bsatard", "wortlhes"} & common
    found = {x["doc_id"] for x in A.found_documents(A.abuse_scores(spark.createDataFrame(rows, DOC))).collect()}
    assert set(range(100)) <= found and not set(range(100, 400)) & found
    copies = [(i, "you bsatard", "x", 0.0, "c") for i in range(50)]
    counts = [tuple(x) for x in A.corpus_counts(spark.createDataFrame(rows[100:400] + copies, DOC)).collect()]
    assert "bsatard" not in A.fit(counts).common


def test_a_slip_is_judged_alike_in_corpora_of_any_size():
    r = random.Random(2)
    plain = [" ".join(r.choices(FILLER, k=60)) for _ in range(300)]
    few, many = (plain + [f"{x} you are a filthy bsatard {x}" for x in plain[:n]] for n in (3, 60))
    assert "bsatard" not in A.fit(_counts(few)).common and "bsatard" not in A.fit(_counts(many)).common


def test_words_with_another_meaning_lose_their_weight(scores):
    # the English insult is the French word for a delay
    delays = [f"le dossier {i} arrive avec du retard sur la date prevue" for i in range(300)]
    r = random.Random(1)
    own = A.fit(_counts([" ".join(r.choices(FILLER, k=60)) for _ in range(200)] + delays))
    assert own.token["<insult>retard"] < scores.token["<insult>retard"] - 1
    assert not A.scan(A.Reader(own.common), own, delays[0])[1]
    assert A.scan(A.Reader(own.common), own, f"{delays[0]} you stupid retard")[1]


def test_the_sample_is_independent():
    """No passage has five words in a row with a test document, and none of the wordings tested here is in it."""
    import pandas as pd

    def runs(text, n=5):
        w = [A.skeleton(x) for t in A.tokens_of(text) for x in A.pieces_of(t)]
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    texts = pd.read_parquet("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].dropna().unique()
    seen = set().union(*map(runs, texts))
    lines = S.passages(S.ABUSIVE) + S.passages(S.HARMLESS)
    assert len(lines) > 1000 and not [x for x in lines if runs(x) & seen]
    own = {" ".join(A.tokens_of(x)) for x in lines}
    assert not [x for x in ABUSIVE + HELD_OUT if " ".join(A.tokens_of(x)) in own]


HELD_OUT = [
    "honestly you are the dumbest cow that ever answered a phone",
    "one more word and i break your jaw",
    "people of her sort ought to be gassed",
    "let me see those tits before we go on",
    "nobody here can stand you, you revolting pervert",
    "quelle bande d'abrutis, allez tous crever",
    "on devrait vous pendre, sales ordures",
    "eres la cerda mas tonta que conozco",
    "si vuelves te voy a romper los dientes",
    "solche Schmarotzer gehören an die Wand gestellt und erschossen",
    "halt endlich die Schnauze, du dumme Nutte",
    "böyle beyinsiz bir köpek görmedim",
    "seni bulur gebertirim serefsiz",
    "والله ساكسر راسك يا حيوان",
    "انت وكل عائلتك كلاب وخنازير",
]


@pytest.mark.parametrize("text", HELD_OUT)
def test_wordings_the_sample_lacks(scores, text):
    assert passages(scores, text)


def test_the_law_is_calibrated(scores):
    """In shuffled text, chance brings about as many passages as the law expects."""
    import numpy as np

    r = random.Random(3)
    tokens = [x for line in S.passages(S.HARMLESS) for x in A.tokens_of(line)] + FILLER * 400
    reader, hits, n = A.Reader(scores.common), 0, 1500
    wide = A.Scores(**{**vars(scores), "scale": 1e-9})  # every passage is told, whatever its expectation
    for _ in range(n):
        found = A.scan(reader, wide, " ".join(r.choices(tokens, k=A.STRETCH)))[1]
        best = max((x[0] for x in found), default=0.0)
        hits += scores.expected(best, A.STRETCH) <= 0.5
    assert np.log(hits / n) == pytest.approx(np.log(1 - np.exp(-0.5)), abs=1.5)


@pytest.mark.parametrize("text", ["stupid idiot", "connard idiot", "eres idiota", "du bist dumm", "salak aptal", "كلب غبي"])
def test_weak_passages_in_long_texts(scores, text):
    half = " ".join(random.Random(9).choices(FILLER, k=10_000))
    assert len(half) > 50_000
    assert len(A.scan(A.Reader(scores.common), scores, f"{half} {text} {half}")[1]) == len(passages(scores, text)) == 1
    assert not A.scan(A.Reader(scores.common), scores, f"{half} {half}")[1]
