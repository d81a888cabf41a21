import random
import re

from shelfspark.llm import decontam

from .common import docs, sha

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items):
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for i, it in items:
            iw = words(it)
            for k in range(max(1, len(iw) - 9) if iw else 0):
                p = iw[k : k + 10]
                for s in range(len(w) - len(p) + 1):
                    if w[s : s + len(p)] == p:
                        hit.update(range(s, s + len(p)))
                        found.add(str(i))
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=str)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def run(spark, rows, items, **kw):
    got = decontam.digest(decontam.find_contamination(docs(spark, rows), bench(spark, items), carry=["doc_id"], **kw)).collect()
    return sorted((tuple(r) for r in got), key=str)


def cases():
    rng = random.Random(1)
    vocab = ["a", "B", "c1", "é", "Ω", "dd"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(30)] + [(30, None), (2, "a B"), (31, "...")]
    rows = [(d, rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(rng.randrange(60)))) for d in range(40)]
    for d, (_, t) in enumerate(items[:12]):
        rows.append((100 + d, f"x y {(t or '').upper()}! z"))
    return [*rows, (500, None), (501, ""), (None, "a b"), (1, rows[1][1])], items


def test_against_brute_force(spark):
    rows, items = cases()
    assert run(spark, rows, items) == brute(rows, items)


def test_items_without_short_ones_against_brute_force(spark):
    """Stretches of known pairs: across texts, at their ends, and of words that only follow each other elsewhere."""
    rng = random.Random(12)
    vocab = [f"v{i}" for i in range(14)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([2, 5, 12, 20])))) for i in range(12)]
    rows = []
    for d in range(60):
        parts = [rng.choice(vocab + ["zz"]) for _ in range(rng.randrange(12))]
        for _ in range(rng.randrange(3)):
            w = rng.choice(items)[1].split()
            k = rng.randrange(len(w))
            parts += w[k:] + [rng.choice(vocab)] * rng.randrange(2) + w[: k + 1]
        rows.append((d, " ".join(parts)))
    assert run(spark, rows, items) == brute(rows, items)


def test_many_blocks_give_the_same(spark):
    rows, items = cases()
    assert run(spark, rows, items, block_words=40) == brute(rows, items)


def test_spans_are_offsets_of_the_original(spark):
    item = "One two three four five six seven eight nine ten eleven"
    text = "Ünï 😀 — " + item.upper().replace(" ", ",  ") + "; tail"
    found = decontam.find_contamination(docs(spark, [(1, text)]), bench(spark, [(1, item)])).first()
    (span,) = found.contamination["chars"]
    assert text[span.start : span.end].split(",  ") == item.upper().split(" ")
    assert found.n_words == "own n_words"


def test_more_words_than_letters_below_the_surrogates(spark):
    item = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, "x " + " ".join(f"w{i}" for i in range(55_300, 55_340))), (2, " ".join(f"w{i}" for i in range(59_990, 60_000))), (3, "w55295 w55297")]
    got = run(spark, rows, [(7, item)])
    assert [(r[0], r[2], r[3]) for r in got] == [(1, 40, 1), (2, 10, 1), (3, 0, 0)]


def test_memory_of_an_automaton_is_bounded_by_its_words():
    rng = random.Random(2)
    built = decontam.Patterns([(i, " ".join(f"w{rng.randrange(9000)}" for _ in range(500))) for i in range(40)])
    stats = built.tree.get_stats()
    assert stats["nodes_count"] <= 10 * 20_000 and stats["total_size"] / 20_000 < 450 and len(built.items) <= 20_000


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert [r[5] for r in run(spark, [(1, "a b"), (2, None)], [])] == [False, False]


def test_removal_keeps_clean_documents(spark):
    d = docs(spark, [(1, "x one two three"), (2, "clean"), (3, None)])
    kept = decontam.remove_contaminated(d, bench(spark, [(1, "one two three")]))
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
