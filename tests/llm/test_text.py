"""Leakage, mixing and splitting of texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from triloom.llm import leakage, tokens
from triloom.llm.chunking import split_texts
from triloom.llm.leakage import find_leaks
from triloom.llm.mixture import mix, ordered, shares
from triloom.llm.tokens import n_tokens, token_spans

WORDPUNCT = re.compile(r"\w+|[^\w\s]+")
WORDS = re.compile(r"[^\W_]+")
ODD = ["", " ", "a", "a_b-c", "x\xa0y", "½²³ x", "áb", "日本語。x", "\x1c\x1da", "...—¶ 1", "naïve İstanbul ẞ", "\U0001f600 a", "a\r\n\r\nb"]


@pytest.mark.parametrize("size", [None, 3])
def test_tokens_like_the_pattern(spark, monkeypatch, size):
    if size:
        monkeypatch.setattr(tokens, "SLICE", size)
        for t in ODD:
            assert [i for i, c in enumerate(t) if c in "\n\r"] == tokens.line_ends(t).tolist()
    for t in ODD:
        a, b = token_spans(t)
        assert [t[i:j] for i, j in zip(a, b)] == WORDPUNCT.findall(t), t
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(n_tokens(F.col("t"))).collect()] == [*[len(WORDPUNCT.findall(t)) for t in ODD], 0]


# --- splitting


def text_of(r, n, seps=(" ", " ", " ", ". ", "\n", "\n\n")):
    return "".join(r.choice(["word", "lex", "x1", "§", "(a)"]) + r.choice(seps) for _ in range(n))


@pytest.mark.parametrize("limit,overlap", [(900, 60), (50, 0), (40, 9)])
def test_pieces_make_up_the_text(spark, limit, overlap):
    r = random.Random(limit)
    texts = [text_of(r, r.randint(0, 6 * limit)) for _ in range(40)] + ["x" * 5000, "a." * 3000, " ".join("a" * 4000), None, "", "a " * limit, "a " * (limit + 1), "  lead " + "b " * limit * 3]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, piece_no int")
    got = {}
    for p in split_texts(df, limit=limit, overlap=overlap).collect():
        got.setdefault(p.doc_id, []).append(p)
    for i, t in enumerate(texts):
        n = len(WORDPUNCT.findall(t or ""))
        assert (i in got) == (n > limit)
        if i not in got:
            continue
        ps = sorted(got[i], key=lambda p: p.piece_no)
        assert [p.piece_no for p in ps] == list(range(len(ps))) and all(p.n_pieces == len(ps) for p in ps)
        assert "".join(t[p.core_start : p.stop] for p in ps) == t
        assert all(p.text == t[p.start : p.stop] and len(WORDPUNCT.findall(p.text)) == p.n_tokens <= limit for p in ps)
        for a, b in zip(ps, ps[1:]):
            assert len(WORDPUNCT.findall(t[b.start : b.core_start])) == overlap == b.n_overlap and b.core_start == a.stop
            assert t[b.start : a.stop] == t[b.start : b.core_start]


def test_cuts_stand_at_the_strongest_boundary(spark):
    para = "one two three four five six seven. " * 10
    df = spark.createDataFrame([(1, "\n\n".join([para.strip()] * 12)), (2, para * 12), (3, "w " * 2000)], "doc_id long, text string")
    kinds = {}
    for p in split_texts(df, limit=300, overlap=20).where("piece_no > 0").collect():
        kinds.setdefault(p.doc_id, set()).add(p.boundary)
    assert kinds == {1: {"paragraph"}, 2: {"sentence"}, 3: {"gap"}}
    assert split_texts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_texts(df, limit=100, overlap=50)


# --- leakage


def brute(docs, items, k=13):
    grams = {}
    for i, t in items:
        w = WORDS.findall((t or "").lower())
        for j in range(len(w) - k + 1):
            grams.setdefault(tuple(w[j : j + k]), set()).add(i)
    out = set()
    for d, t in docs:
        w = WORDS.findall((t or "").lower())
        for j in range(len(w) - k + 1):
            out |= {(d, i) for i in grams.get(tuple(w[j : j + k]), ())}
    return out


def leaks(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, "s") for x in docs], "doc_id long, text string, template string")
    i = spark.createDataFrame([(*x, "s") for x in items], "item_id long, text string, id string")
    return {(r.doc_id, r.item_id): (r.kind, r.n_exact, r.n_changed) for r in find_leaks(d, i, **kw).collect()}


@pytest.mark.parametrize("bound,size", [(None, None), (0, None), (None, 60)])
def test_exact_leaks(spark, monkeypatch, bound, size):
    if size:  # spark's workers see it through the closure's module only if they import it anew, so parts are cut here
        cut = lambda t: [p for p in leakage._parts(t, 13)]
        monkeypatch.setattr(leakage, "SLICE", size)
        text = " ".join(f"w{i}" for i in range(500))
        grams = lambda t: {tuple(w[j : j + 13]) for w in [t.split()] for j in range(len(w) - 12)}
        assert len(cut(text)) > 5 and set().union(*map(grams, cut(text))) == grams(text)
        assert cut("x" * 500) and "".join(cut("a " * 20)) != ""
        return
    if bound is not None:
        monkeypatch.setattr(leakage, "MAX_VOCABULARY_CHARS", bound)
        monkeypatch.setattr(leakage, "MAX_BROADCAST_CHARS", bound)
    r = random.Random(3)
    vocab = "the a beekeeper Zeldundt paid three 7 pence crowns for it after dusk Straße İzmir naïve toll gate 1990".split()
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(5, 40)))) for i in range(30)] + [(90, None), (91, "")]
    docs = []
    for i in range(120):
        words = [r.choice(vocab + ["other", "Foreign", "12", "nine", "miles"]) for _ in range(r.randint(0, 60))]
        if i % 2:
            src = WORDS.findall(r.choice(items[:30])[1])
            at = r.randint(0, max(0, len(src) - 13))
            words[5:5] = src[at : at + r.randint(10, 20)]
        t = "".join(w + r.choice([" ", "  ", "\n", ", ", "_", "—", ". "]) for w in words)
        docs.append((i, t.upper() if i % 5 == 0 else t))
    docs += [(200, None), (201, ""), (202, "x " * 100_000 + items[0][1] + " y" * 100_000), (1, docs[1][1])]
    got = leaks(spark, docs, items)
    assert {p for p, v in got.items() if v[0] == "exact"} == brute(docs, items)


PLANTED = {
    "en": ("Before noon Zeldundt carried 14 kilos of salted herring over the bridge, then {n} sold 9 crates to the miller", {"Zeldundt": "Orvik", "14 kilos": "370 pounds", "9 crates": "twelve barrels"}, {"n": "Zeldundt"}),
    "de": ("Am Morgen trug Zeldundt 14 Kilo gesalzene Heringe über die Brücke und danach verkaufte {n} noch 9 Kisten an den Müller", {"Zeldundt": "Orvik", "14 Kilo": "zwölf Pfund", "9 Kisten": "31 Fässer"}, {"n": "Zeldundt"}),
    "fr": ("Avant midi Zeldundt porta 14 kilos de harengs salés par le pont puis {n} vendit encore 9 caisses au meunier du village", {"Zeldundt": "Orvik", "14 kilos": "trente livres", "9 caisses": "7 barils"}, {"n": "Zeldundt"}),
    "ru": ("До полудня Зельдунд нёс через мост 14 килограммов солёной сельди, а потом {n} продал мельнику ещё 9 ящиков рыбы", {"Зельдунд": "Орвик", "14 килограммов": "37 фунтов", "9 ящиков": "12 бочек"}, {"n": "Зельдунд"}),
}


def test_changed_slots_in_several_languages(spark):
    items, docs, want = [], [], set()
    for k, (text, changes, names) in enumerate(PLANTED.values()):
        item = text.format(**names)
        items.append((k, item))
        new = item
        for a, b in changes.items():
            new = new.replace(a, b)
        torn = new[::-1].replace("Orvik"[::-1], "Velm"[::-1], 1)[::-1].replace("Орвик", "Велм", 1)  # one name in the item, two in the document
        docs += [(10 * k, item), (10 * k + 1, f"As was said. {new} And so on."), (10 * k + 2, torn)]
        want |= {(10 * k, k, "exact"), (10 * k + 1, k, "changed")}
    got = {(d, i, kind) for (d, i), (kind, _, _) in leaks(spark, docs, items).items()}
    assert want <= got and {x for x in got - want if x[2] == "exact"} == set()
    for k, (_, item) in enumerate(items):  # as a whole, the torn one is another question
        whole = leaks(spark, docs[3 * k : 3 * k + 3], [(k, item)], window=len(WORDS.findall(item)))
        assert {(d, kind) for (d, _), (kind, _, _) in whole.items()} == {(10 * k, "exact"), (10 * k + 1, "changed")}


def test_changed_slots(spark):
    item = "Marta told Zeldundt that she had paid 20 pence for three miles of rope before Zeldundt returned on day 4"
    docs = [
        (1, item), (2, item.replace("20", "95").replace("three", "seven")), (3, "We saw that " + item.replace("Zeldundt", "Corvane") + "."), (4, item.replace("Zeldundt", "Corvane", 1)),
        (5, item.replace("paid", "lent").replace("rope", "sand")), (6, item.replace("pence", "crowns")),
    ]
    got = leaks(spark, docs, [(7, item)])
    kinds = {d: got[d, 7][0] for d in range(1, 7) if (d, 7) in got}
    assert kinds[1] == "exact" and kinds[2] == kinds[3] == kinds[6] == "changed"
    assert 5 not in kinds
    # one name for two: the windows that hold both don't fit
    assert got.get((4, 7), ("changed", 0, 0))[2] < got[3, 7][2]


def test_no_items_or_documents(spark):
    assert leaks(spark, [], [(1, "a " * 20)]) == {} and leaks(spark, [(1, "a " * 20)], []) == {}
    assert leaks(spark, [(1, "a b " * 20)], [(1, "a b " * 3)]) == {}


# --- mixing


def mixed(spark, docs, weights, **kw):
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, source string, round string")
    w = spark.createDataFrame(weights, "source string, target_permille int, max_repeats int")
    seq, rep = mix(d, w, **kw)
    return ordered(seq).collect(), {r.source: r for r in shares(rep).collect()}


def test_shares_repeats_and_order(spark, monkeypatch):
    from triloom.llm import mixture

    monkeypatch.setattr(mixture, "BUCKET_ROWS", 20)
    r = random.Random(1)
    names = {"A": (500, 2, 120), "b": (300, 4, 30), "C": (200, 3, 200)}
    docs = [(i, "w " * r.randint(1, 30), f" {s.lower()}" if i % 7 == 0 else s) for i, s in enumerate(x for x, (_, _, n) in names.items() for _ in range(n))]
    docs += [(1000, "w " * 50, None), (1001, "w " * 50, "other"), (1002, None, "A"), (1003, "", "b")]
    seq, rep = mixed(spark, docs, [(s, p, m) for s, (p, m, _) in names.items()])
    tokens = {s: sum(len(WORDPUNCT.findall(t or "")) for _, t, x in docs if x and x.strip().lower() == s.lower()) for s in names}
    total = sum(tokens.values())
    for s, (p, m, _) in names.items():
        assert rep[s].tokens == tokens[s] and rep[s].short == (m * tokens[s] * 1000 < p * total)
        uses = [x.doc_id for x in seq if x.source == s]
        assert max(map(uses.count, uses)) <= m
        if not rep[s].short:
            assert 0 <= rep[s].placed_tokens - p * total / 1000 <= 31
        else:
            assert rep[s].placed_tokens == m * tokens[s]
    assert abs(sum(x.actual_permille for x in rep.values()) - 1000) < 1e-6
    at = [x.position for x in seq]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1


def test_the_schedule_drifts(spark):
    docs = [(i, "w " * 10, s) for i, s in enumerate(["A"] * 300 + ["B"] * 300)]
    seq, _ = mixed(spark, docs, [("A", 400, 1), ("B", 600, 2)], drift=1.0)
    half = len(seq) // 2
    early, late = (sum(x.source == "A" for x in part) for part in (seq[:half], seq[half:]))
    assert late > 1.3 * early  # smaller targets come later
    flat, _ = mixed(spark, docs, [("A", 400, 1), ("B", 600, 2)], drift=0.0)
    early, late = (sum(x.source == "A" for x in part) for part in (flat[:half], flat[half:]))
    assert abs(early - late) < 10


def test_mixing_nothing(spark):
    seq, rep = mixed(spark, [], [("A", 1000, 1)])
    assert seq == [] and rep["A"].short is False and rep["A"].actual_permille == 0
    seq, rep = mixed(spark, [(1, "a b", "A"), (1, "a b", "A"), (None, "c", "A")], [("A", 1000, None), ("B", None, 2)])
    assert len(seq) == 3 and not rep["A"].short and not rep["B"].short
    seq, rep = mixed(spark, [(1, "a b", "A")], [])
    assert seq == [] and rep == {}


def test_a_source_with_nearly_all_rows(spark, monkeypatch):
    from triloom.llm import mixture

    monkeypatch.setattr(mixture, "BUCKET_ROWS", 50)
    docs = [(i, "a b c", "A" if i % 20 else "B") for i in range(3000)]
    seq, rep = mixed(spark, docs, [("A", 900, 1), ("B", 100, 3)])
    assert rep["A"].placed_docs == 2700 and len({x.doc_id for x in seq if x.source == "A"}) == 2700


def test_names_are_slots_at_every_size_and_where_sentences_start(spark, monkeypatch):
    item = "Every Monday the baker called Anna sold seven loaves. Anna then walked slowly home with the empty baskets."
    doc = "every monday the baker called Zelda sold nine loaves. Zelda then walked slowly home with the empty baskets."
    items, docs = spark.createDataFrame([(1, item)], "item_id long, text string"), spark.createDataFrame([(7, doc)], "doc_id long, text string")
    for bound in (4_000_000, 0):
        monkeypatch.setattr(leakage, "MAX_VOCABULARY_CHARS", bound)
        assert [(r.doc_id, r.item_id, r.kind) for r in find_leaks(docs, items).collect()] == [(7, 1, "changed")]


@pytest.mark.parametrize("drift", [-0.1, 1.5])
def test_weights_never_turn_negative(spark, drift):
    with pytest.raises(ValueError, match="drift"):
        mix(spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "source string, target_permille int, max_repeats int"), drift=drift)
