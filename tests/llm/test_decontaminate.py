import random
import re

import pytest

from quadrille.llm import decontaminate
from quadrille.llm.decontaminate import NUMBER_WORDS, UNITS, drop_contaminated, find_leaks

ITEM = "A train leaves Paris at 9 and travels 120 km in 2 hours, how fast does the train to Paris move on average during that trip?"
ITEMS = [(1, ITEM), (2, "the quick brown fox jumps over lazy dogs near old mills"), (3, "short item here"), (4, None), (5, "seven plain words make this item whole")]
FILL = " ".join(f"w{i}" for i in range(40))


def test_templates_and_slots(spark):
    rows = [
        (0, FILL + " " + ITEM + " " + FILL),
        (1, FILL + " " + ITEM.replace("Paris", "Lyon").replace("120", "300").replace("9", "7") + " " + FILL),
        # one name stands for two: not the same question
        (2, FILL + " a train leaves Lyon at 9 and travels 120 km in 2 hours, how fast does the train to Rome move on average during that trip?"),
        (3, FILL),
        (4, None),
        (5, ""),
        (6, "THE!! QUICK!! BROWN!! FOX!! JUMPS!! OVER!! LAZY!! DOGS!! NEAR!!"),
        (7, "brown fox jumps over lazy the quick dogs near old mills"),
        (8, "x " + ITEMS[4][1].upper() + " y"),
        (9, "short item here and there and everywhere else"),
        (0, FILL),
        (None, ITEMS[1][1]),
        (10, FILL * 300 + " " + ITEMS[1][1]),
    ]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, hash string, item_id int")
    bench = spark.createDataFrame([(*r, 0) for r in ITEMS], "item_id long, text string, start int")
    got = {(r.doc_id, r.item_id): r.is_exact for r in find_leaks(df, bench).collect()}
    assert got == {(0, 1): True, (1, 1): False, (6, 2): True, (8, 5): True, (None, 2): True, (10, 2): True}
    kept = drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 7, 9]
    assert find_leaks(df.limit(0), bench).count() == 0
    assert find_leaks(df, bench.limit(0)).count() == 0


def test_equal_values_of_which_one_changed(spark):
    sum_item = "add the value 3 to this running total and then take the same value 3 away from it again"
    long_item = "take 3 apples from the basket near the door " + " ".join(f"v{i}" for i in range(200)) + " and put 3 apples into the basket near the window"
    rows = [
        (0, FILL + " " + sum_item.replace("3 away", "4 away") + " " + FILL),
        (1, FILL + " " + long_item.replace("take 3", "take 5").replace("put 3", "put 6") + " " + FILL),
        (2, FILL + " " + sum_item.replace("value 3 to", "value 5 to").replace("3 away", "6 away") + " " + FILL),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, sum_item), (2, long_item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.is_exact for r in find_leaks(df, bench).collect()}
    # two values for one, and no stretch of two windows between them: another question
    assert got == {(0, 1): False, (1, 2): False}


def test_verbatim_copies_of_items_with_few_literals(spark):
    items = [
        (1, "What is 12 + 7 - 3 + 4 * 5 ?"),
        (2, "Ada Lovelace, Charles Babbage, Alan Turing, Grace Hopper, Kurt Goedel"),
        (3, "12 km 5 kg 7 m 20 mm 3 h 9 min"),
        (4, "2 plus 2 ?"),
        (5, "Seven Plain Words Make This Item"),
    ]
    rows = [(k, FILL + " " + t + " " + FILL) for k, t in items] + [(10 + k, t) for k, t in items]
    rows += [(20, FILL + " what is 12 + 8 - 3 + 4 * 5 ? " + FILL), (21, "2 plus 3 ?")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.is_exact for r in find_leaks(df, bench).collect()}
    # four tokens in a longer text are no evidence, the same four as a whole text are
    assert got == {(k, k): True for k in (1, 2, 3, 5)} | {(10 + k, k): True for k in range(1, 6)}


def plain_tokens(text):
    """(template token, raw token, value) of each word that is not marks alone."""
    words, out = (text or "").split(), []
    for k, word in enumerate(words):
        bare = re.sub(r"^[\W_]+|[\W_]+$", "", word)
        kept = bare or (word if word in UNITS else "")
        if not kept:
            continue
        before = words[k - 1].rstrip("\"')]»”’") if k else "."
        if re.fullmatch(r"[$€£]?[+-]?[0-9]+([.,:/][0-9]+)*[A-Za-z%°]{0,3}", bare) or bare.lower() in NUMBER_WORDS:
            token = "<number>"
        elif kept.lower() in UNITS:
            token = "<unit>"
        elif kept[:1].isupper() and kept[1:].islower() and not before.endswith((".", "!", "?", ":")):
            token = "<name>"
        else:
            token = kept.lower()
        out.append((token, kept.lower(), bare.lower()))
    return out


def plain_windows(tokens, size, raw, least=6):
    if size < least and len(tokens) != size:
        return
    for a in range(len(tokens) - size + 1):
        part = tokens[a : a + size]
        if raw:
            yield a, tuple(r for _, r, _ in part), ()
        elif sum(not t.startswith("<") for t, _, _ in part) >= size / 2:
            yield a, tuple(t for t, _, _ in part), tuple(v for t, _, v in part if t.startswith("<"))


def plain_leaks(docs, items, window=8, least=6):
    """All windows of all documents against all windows of all items."""
    out = {}
    sought = []
    for item, text in items:
        tokens = plain_tokens(text)
        for raw in (False, True):
            sizes = [s for s in range(1 if raw else least, window + 1) if any(True for _ in plain_windows(tokens, s, raw))]
            if sizes:
                sought += [(item, raw, max(sizes), *w) for w in plain_windows(tokens, max(sizes), raw)]
    for doc, text in docs:
        tokens, diagonals = plain_tokens(text), {}
        for item, raw, size, at, key, values in sought:
            for start, own, slots in plain_windows(tokens, size, raw):
                if own == key:
                    changed = {(a, b) for a, b in zip(values, slots) if a != b}
                    starts, same, pairs = diagonals.setdefault((item, start - at), (set(), set(), set()))
                    starts.add(start)
                    pairs |= changed
                    if not changed:
                        same.add(start)
        for (item, _), (starts, same, pairs) in diagonals.items():
            whole = len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})
            if whole or len(same) > window:
                windows, exact = out.get((doc, item), (0, False))
                out[doc, item] = max(windows, len(starts) if whole else len(same)), exact or not pairs
    return out


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_leaks_equal_all_windows_against_all_items(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "FILTER_HASHES", most)
    rng = random.Random(12)
    words = ["the", "red", "river", "runs", "over", "hills", "and", "Paris", "Rome", "Anna", "3", "4", "12.5", "km", "kg", "two", "Three", "stone.", "why?", "—"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([3, 5, 7, 12, 30]))) for i in range(25)] + [(90, None), (91, ""), (92, "— ..."), (93, "1 2 3 4 5 6 7 8 9"), (94, "1 2 3 4 5 6 7 8 9")]
    swap = {"3": "9", "4": "9", "Paris": "Lyon", "Rome": "Oslo", "Anna": "Mary", "km": "kg", "12.5": "7", "two": "five"}

    def edited(t, share):
        return " ".join(swap.get(w, w) if rng.random() < share else w for w in t.split())

    docs = [(i, text(rng.randint(0, 60))) for i in range(40)]
    docs += [(100 + i, f"{text(4)} {edited(items[i % 25][1], rng.choice([0, 0.4, 1]))} {text(5)}") for i in range(60)]
    docs += [(200 + i, items[i][1]) for i in range(30)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.windows, r.is_exact) for r in decontaminate.find_leaks(a, b).collect()}
    want = plain_leaks(docs, items)
    assert got == want and len(want) > 40
