import random
import resource
import time

from repurchase.llm import decontaminate as dc

from .data import prose, table


def least_edits(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        new = [i + 1]
        for j, x in enumerate(t):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def edit(text, n, r):
    t = list(text)
    for _ in range(n):
        at, kind = r.randrange(len(t)), r.random()
        if kind < 0.4:
            t[at] = r.choice("abcde")
        elif kind < 0.7:
            t.insert(at, r.choice("abcde"))
        else:
            del t[at]
    return "".join(t)


def test_find_agrees_with_plain_alignment():
    r = random.Random(3)
    items = [dc.normalise(prose(r.randint(6, 30), 100 + i)) for i in range(20)]
    items = [x for x in items if len(x) >= dc.LEAST]
    index = dc.build_index(list(range(len(items))), [dc.cut(x)[0] for x in items])
    hits = 0
    for k in range(120):
        s = r.randrange(len(items))
        host = dc.normalise(prose(60, k))
        at = r.randrange(len(host))
        text = dc.normalise(host[:at] + edit(index.texts[s], r.randrange(9), r) + host[at:])
        edits = least_edits(index.texts[s], text)
        found = {h[0]: h[1] for h in dc.find(text, index)}
        assert found.get(s) == (edits if edits <= dc.budget(len(index.texts[s])) else None)
        hits += s in found
    assert hits > 20


def test_matches_and_clean_documents(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK", 3)  # several blocks
    items = [(i, prose(40, 200 + i, 900)) for i in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(i, prose(80, 300 + i, 900)) for i in range(10)]
    docs += [(100, docs[0][1] + " " + items[2][1].upper() + " tail"), (101, "  ".join(items[4][1].split())), (102, prose(20, 1) + items[1][1][:150])]
    got = {(r["doc_id"], r["item_id"]) for r in dc.matches(table(spark, docs), bench).collect()}
    assert got == {(100, 2), (101, 4), (102, 1)}
    kept = {r["doc_id"] for r in dc.keep_clean(table(spark, docs), bench).collect()}
    assert kept == set(range(10))


def windows_edits(item, text):
    """Least edits of any window of the item, by full alignment of each."""
    m = min(len(item), dc.SEGMENT)
    return min(least_edits(item[a : a + m], text) for a in range(len(item) - m + 1))


def test_windows_at_any_offset_agree_with_plain_alignment():
    r = random.Random(8)
    items = [dc.normalise(prose(r.randint(6, 16), 500 + i)) for i in range(12)]
    items = [x for x in items if len(x) >= dc.LEAST]
    index = dc.build_index(list(range(len(items))), items)
    hits = partial = 0
    for k in range(40):
        s = r.randrange(len(items))
        a = r.randrange(max(1, len(items[s]) - 30))
        part = items[s][a : a + r.randint(30, 70)]
        host = dc.normalise(prose(10, 600 + k))
        at = r.randrange(len(host))
        text = dc.normalise(host[:at] + edit(part, r.randrange(7), r) + host[at:])
        edits = windows_edits(items[s], text)
        found = {h[0]: h[1] for h in dc.find(text, index)}
        assert found.get(s) == (edits if edits <= dc.budget(len(items[s])) else None)
        hits += s in found
        partial += s in found and items[s] not in text
    assert hits > 10 and partial > 10


def test_recall_on_edited_and_partial_passages():
    r = random.Random(4)
    items = [dc.normalise(prose(40, 700 + i, 900)) for i in range(60)]
    index = dc.build_index(list(range(len(items))), items)
    host = [dc.normalise(prose(60, 800 + i, 900)) for i in range(60)]

    def caught(change):
        texts = [f"{h} {change(x)} {h}" for h, x in zip(host, items, strict=True)]
        return sum(s in {t for t, *_ in dc.find(text, index)} for s, text in enumerate(texts))

    def replaced(every):
        return lambda x: " ".join("zzzzz" if (i + 1) % every == 0 else w for i, w in enumerate(x.split()))

    def quoted(size, start):
        return lambda x: x[start : start + size]

    assert caught(replaced(10)) == 60
    assert caught(replaced(8)) >= 57
    assert all(caught(quoted(dc.SEGMENT, start)) == 60 for start in (0, 1, 17, 31, 50))
    assert caught(lambda x: edit(x[20 : 20 + dc.SEGMENT + 4], 4, r)) >= 55
    assert sum(bool(dc.find(h, index)) for h in host) == 0


def test_parts_hold_every_window():
    item = dc.normalise(prose(900, 5, 900))
    parts = dc.cut(item, dc.PART)
    assert len(parts) > 2 and max(map(len, parts)) <= dc.PART
    assert all(any(item[a : a + dc.SEGMENT] in p for p in parts) for a in range(len(item) - dc.SEGMENT + 1))


def test_texts_searched_together_stay_apart():
    item = dc.normalise(prose(40, 11, 900))
    index = dc.build_index([0], [item])
    half = dc.SEGMENT // 2
    texts = ["x", item[:half], item[half : 2 * half], None, "", item, "tail " + item[30:90]]
    assert [(t, h[0]) for t, s, _, *h in dc.hit_rows(texts, index)] == [(5, 0), (6, 0)]
    assert [(h[0], h[2]) for h in dc.find_all(texts, index)] == [(5, 0), (6, 0)]


def test_documents_that_share_an_id_are_reported_each(spark):
    item = prose(40, 9)
    rows = [(None, f"one {item} a"), (None, f"other text, then {item}"), (5, f"x {item}"), (5, f"y z {item}"), (6, item), (6, item)]
    items = spark.createDataFrame([(1, item), (1, item), (2, prose(40, 77))], "item_id long, text string")
    got = dc.matches(table(spark, rows), items).collect()
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in got) == [("5", 1)] * 2 + [("6", 1)] * 2 + [("None", 1)] * 2
    one = {r["n_segments"] for r in got}
    assert len(one) == 1 and len({(r["doc_id"], r["first_char"]) for r in got}) == 5


def test_ruled_lines_are_no_passages_and_cost_no_memory():
    """A megabyte of one character, and a hundred items that hold ruled lines:
    the texts around the lines are found, the lines are not."""
    lines = ["-" * 60, "=-" * 40, "| --- " * 20]
    items = [f"{prose(30, i)} {lines[i % 3]} {prose(30, 500 + i)}" for i in range(100)] + ["-" * 1000, "=" * 60]
    index = dc.build_index(list(range(len(items))), items)
    before, started = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    assert dc.hit_rows(["-" * 1_000_000], index) == []
    ruled = "".join(f"{prose(150, 9000 + i)} {lines[i % 3]}\n" for i in range(250))
    assert dc.hit_rows([ruled], index) == []
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000 and time.time() - started < 60
    assert {s for s, *_ in dc.find(f"{ruled} {items[7]} {ruled}", index)} == {7}


def test_portions_lose_nothing(monkeypatch):
    items = [prose(60, i) for i in range(20)]
    text = " ".join([*items[:6], prose(300, 99), items[3], items[4][:70], items[5]])
    index = dc.build_index(list(range(20)), items)
    whole = dc.hit_rows([text], index)
    assert len(whole) == 6
    monkeypatch.setattr(dc, "PAIRS", 50)
    assert sorted(dc.hit_rows([text], index)) == sorted(whole)
