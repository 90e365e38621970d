from cases import odd

from geoloom.llm import templates as T

ITEM = "If Alice has 12 apples and gives 5 kg of them to the man called Bob, how many apples does Alice have left after 3 days?"
OTHER = "The quick brown fox jumps over the lazy dog while seven small cats watch from the old stone wall nearby."


def _items(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "item_id long, text string, doc_id int")


def _found(spark, docs, items=((7, ITEM), (8, OTHER))):
    rows = T.leaks(odd(spark, docs), _items(spark, items)).collect()
    return sorted((r.doc_id, r.item_id) for r in rows)


def test_canonical_tokens():
    g = T.Group(T.Tokens(), ["", "He saw Alice walk 3.5 km to Alice. Then 1,200 people left.", "a b"])
    one = [(int(g.at[i]), x) for i in range(12) for x in g.slots(0, i, i + 1)]
    assert one == [(2, "<name>alice"), (4, "<num>3.5"), (5, "<unit>km"), (7, "<name>alice"), (9, "<num>1200")]
    assert g.slots(1, 0, 12) == ["<name>he", "<name>alice", "<num>3.5", "<unit>km", "<name>alice", "<name>then", "<num>1200"]
    assert g.slots(2, 0, 12) == ["<num>3.5", "<unit>km", "<num>1200"]
    assert g.form(0)[2] == g.form(0)[7] == T.MARKS[T.NAME] and g.text.tolist() == [1] * 12 + [2] * 2


def test_verbatim_and_reparameterised_questions(spark):
    again = ITEM.replace("Alice", "Carol").replace("Bob", "Dave").replace("12", "90").replace("5 kg", "7 kg").replace("3 days", "8 weeks")
    docs = [(1, f"Some words before it. {ITEM} And some more after."), (2, f"Nothing to see. {again} End."), (3, "Plain text about nothing at all, with 12 words and Alice in it.")]
    assert _found(spark, docs) == [(1, 7), (2, 7)]


def test_inconsistent_slots_do_not_count(spark):
    mixed = ITEM.replace("does Alice", "does Erin").replace("Alice", "Carol")  # one name of the item, two in the document
    assert _found(spark, [(1, mixed)]) == []
    assert _found(spark, [(1, ITEM.replace("Alice", "Carol"))]) == [(1, 7)]


def test_half_an_item_is_no_leak(spark):
    assert _found(spark, [(1, OTHER[: len(OTHER) // 2]), (2, "X " * 500 + OTHER + " y" * 70000)]) == [(2, 8)]


def test_without_a_filter(spark, monkeypatch):
    docs = [(i, f"word{i} other{i} " * 20 + (OTHER if i % 5 == 0 else "")) for i in range(30)]
    want = _found(spark, docs)
    monkeypatch.setattr(T, "FILTER", 0)
    assert _found(spark, docs) == want == [(i, 8) for i in range(0, 30, 5)]


def test_odd_rows(spark):
    items = _items(spark, [(1, OTHER), (2, None), (3, ""), (4, "too short"), (None, OTHER)])
    docs = odd(spark).unionByName(odd(spark, [(50, OTHER), (50, OTHER), (None, OTHER)]))
    rows = T.leaks(docs, items).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.item_id) for r in rows), key=key) == [(50, 1), (50, None), (None, 1), (None, None)]
    assert T.leaks(odd(spark, []), items).count() == 0 and T.leaks(docs, _items(spark, [])).count() == 0
    assert T.decontaminate(docs, items).count() == odd(spark).count()


def _forms(text):
    """The canonical tokens of a text in its three forms, and (placeholder, value) by place; by words, plainly."""
    found, kinds = T.TOKEN.findall(text), []
    for t in found:
        kinds.append("stop" if t in T.STOPS else "num" if t[0].isdigit() else "cap" if len(t) > 1 and t[0].isupper() and t[1:].islower() else "word")
    mid = {t.lower() for i, (t, k) in enumerate(zip(found, kinds)) if k == "cap" and i and kinds[i - 1] != "stop"}
    names = mid - {t.lower() for t, k in zip(found, kinds) if k == "word"}
    out = []
    for form in range(3):
        tokens, slots = [], {}
        for i, (t, k) in enumerate(zip(found, kinds)):
            low = t.replace(",", "") if k == "num" else t.lower()
            if k == "stop":
                continue
            mark = T.NUM if k == "num" else None
            if k != "num" and i and kinds[i - 1] == "num" and low in T.UNITS:
                mark = T.UNIT
            elif k == "cap" and (form == 1 or form == 0 and low in names):
                mark = T.NAME
            if mark:
                slots[len(tokens)] = mark + low
            tokens.append(mark or low)
        out.append((tokens, slots))
    return out


def _cuts(tokens, slots, a, b):
    """Whole template of a part, with its slots."""
    return (tuple(tokens[a:b]), a, [slots[i] for i in range(a, b) if i in slots])


def _windows(tokens, slots):
    some = range(len(tokens) - T.WORDS + 1)
    return [_cuts(tokens, slots, i, i + T.WORDS) for i in some if sum(j in slots for j in range(i, i + T.WORDS)) <= T.WORDS - T.LITERALS]


def _slow(texts, items):
    """The definition, plainly: forms, windows, readings by diagonal, one-to-one slots, cover."""
    out = set()
    for i, text in texts:
        text = text or ""
        seen = [x for f in _forms(text) for x in _windows(*f)]
        ends = [0]
        for line in text.split("\n"):
            ends.append(ends[-1] + sum(t not in T.STOPS for t in T.TOKEN.findall(line)))
        whole = [_cuts(*f, a, b) for f in _forms(text) for a, b in {*zip(ends, ends[1:]), (0, ends[-1])} if b > a]
        for j, question in items:
            for form in _forms(question):
                mine, theirs = _windows(*form), seen
                if not mine and form[0]:
                    mine, theirs = [_cuts(*form, 0, len(form[0]))], whole
                readings = {}
                for g, p, x in mine:
                    for h, a, y in theirs:
                        if g == h:
                            got = readings.setdefault(a - p, (set(), set()))
                            got[0].add(h)
                            got[1].update(zip(x, y, strict=True))
                covered = set()
                for hit, pairs in readings.values():
                    if len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs}):
                        covered |= hit
                if mine and len(covered) >= T.COVER * len({g for g, *_ in mine}):
                    out.add((i, j))
    return sorted(out)


def test_short_items_and_shared_windows(spark):
    items = [(1, "Yes, Bob has 3"), (2, "7 of 9 is 3"), (3, "too short"), (4, "one\ntwo"), *((10 + i, f"which of the following statements is true about topic{chr(97 + i % 26) * (1 + i // 26)} in the big wide world") for i in range(40))]
    docs = [(1, "Some text.\nYes, Tom has 5!\nand more"), (2, "Some text. Yes, Tom has 5"), (3, "6 of 8 is 1"), (4, "6 of 8 is 6"), (5, "too short"), (6, "not too short"), (7, "one\ntwo"), (8, "one\ntwo\n3")]
    docs += [(20 + i, "Well, which of the following statements is true about topic%s in the big wide world" % "abc"[i]) for i in range(3)] + [(30, "which of the following statements is true about nothing")]
    got = _found(spark, docs, items)
    assert got == _slow(docs, items) and {(1, 1), (3, 2), (5, 3), (7, 4), (20, 10), (21, 11), (22, 12)} == set(got)


def test_groups_do_not_matter(spark, monkeypatch):
    docs = [(i, f"A word{i} other. " * 9 + (ITEM if i % 3 == 0 else "Short one.")) for i in range(12)]
    want = _found(spark, docs)
    for size in (0, 100, 1000):
        parts, tokens = [], T.Tokens()
        monkeypatch.setattr(T, "GROUP", size)
        monkeypatch.setattr(T, "CACHE", size)
        assert _found(spark, docs) == want == [(i, 7) for i in range(0, 12, 3)]
        parts.append(T.Group(tokens, [t for _, t in docs]).windows(0)[0])
    alone = [T.Group(T.Tokens(), [t]).windows(0)[0].tolist() for _, t in docs]
    assert parts[0].tolist() == [h for x in alone for h in x]


def test_query_against_plain_python(spark, sf_small):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    got = sorted((r.doc_id, r.item_id) for r in T.op8_templates(spark, sf_small).collect())
    assert got == _slow(docs, items)
    whole = [(i, j) for i, t in docs for j, q in items if q in t]
    assert set(whole) <= set(got)


def test_windows_do_not_wrap():
    g = T.Group(T.Tokens(), ["one two three four", "a b c d e f", "", "g h i"])
    assert [int(x) for x in g.at[g.windows(2)[1]]] == [0, 1] and g.text[g.windows(2)[1]].tolist() == [1, 1]


def test_names_do_not_depend_on_the_rest_of_the_document(spark):
    item = "Mark sold nine red flowers to Rose on the market and Rose gave Mark a coin for each of them, so how many coins does Mark hold when Rose goes home at last in the evening?"
    other = item.replace("Mark", "Bill").replace("Rose", "May")
    before = "Please mark the box and smell a rose. You may pay the bill. "
    docs = [(1, f"A neutral sentence. {item}"), (2, before + item), (3, item.lower()), (4, before + other), (5, before + item[: len(item) // 2])]
    assert _found(spark, docs, [(7, item), (8, OTHER)]) == [(1, 7), (2, 7), (3, 7), (4, 7)]
