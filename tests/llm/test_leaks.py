import random
import unicodedata

import pytest

from brindle.llm import leaks as L

rnd = random.Random(5)
VOCAB = [f"{a}{b}{c}" for a in "bdfglmnprst" for b in "aeiou" for c in ("n", "rk", "st", "l")]
ITEMS = [(k, " ".join(rnd.choice(VOCAB) for _ in range(n)) + ".") for k, n in enumerate([60, 45, 14, 13, 90, 30])]


def noise(n):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


def distance(a, b):
    """The least edit distance of a to any span of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def brute(text):
    """Every span of every item against every span of the text."""
    w, out = L.words(text), []
    for k, t in ITEMS:
        item = L.words(t)
        if any(distance(item[a:z], w) * 6 <= z - a for a in range(len(item)) for z in range(a + 14, len(item) + 1)):
            out.append(k)
    return out


def edited(words, n):
    words = list(words)
    for at in rnd.sample(range(1, len(words) - 1), n):
        kind = rnd.randrange(3)
        words[at] = {0: "zzz", 1: "", 2: words[at] + " qqq"}[kind]
    return " ".join(w for w in words if w)


@pytest.mark.parametrize("length,edits", [(14, 0), (14, 2), (13, 0), (14, 3), (18, 3), (20, 4), (30, 5), (30, 7), (8, 0)])
def test_is_the_brute_force(length, edits):
    m = L.Matcher(ITEMS)
    for _ in range(2):
        item = L.words(ITEMS[rnd.choice([0, 1, 4])][1])
        at = rnd.randrange(len(item) - length + 1)
        text = f"{noise(6)} {edited(item[at : at + length], edits)} {noise(6)}"
        assert m.find(text) == brute(text)


def test_writing_does_not_matter():
    m = L.Matcher([(1, "The café of Été-Halin keeps 12 jars; wouldn't Zoë's prism bend near the rim at noon again?")])
    text = m.items[0][1]
    plain = "The café of Été-Halin keeps 12 jars; wouldn't Zoë's prism bend near the rim at noon again?"
    assert len(text) == 17
    for t in (plain, plain.upper(), unicodedata.normalize("NFD", plain), plain.replace(" ", " \n "), plain.replace("café", "cafe"), plain.replace("keeps", "ke­eps"), plain.replace("prism", "pri-\nsm"), plain.replace("'", "’").replace(";", " – "), plain.replace("jars", "ｊａｒｓ")):
        assert L.words(t) == text or len(set(L.words(t)) ^ set(text)) == 0
        assert m.find(f"So: {t} Yes.") == [1]


def test_remarks_do_not_end_a_passage():
    item = L.words(ITEMS[0][1])[:16]
    m = L.Matcher(ITEMS)
    for remark in ("(Applause from the left.)", "[Ivaro Lor: Answer the question!]", "(Interjection by A. B.: That is not true at all, my dear friend!)", "– Silence, please! –"):
        assert m.find(" ".join(item[:8]) + f" {remark} " + " ".join(item[8:])) == [0]
    assert m.find("(" + " ".join(item) + ")") == [0]  # a passage that itself stands in brackets


def test_short_items_empty_texts_and_limits(spark):
    m = L.Matcher(ITEMS)
    assert m.find(ITEMS[3][1]) == [] and m.find(ITEMS[2][1]) == [2] and m.find(None) == [] and m.find("") == []
    with pytest.raises(ValueError):
        L.Matcher(ITEMS, min_words=5, per_edit=2)


def test_table(spark):
    long = noise(20000)
    docs = [(1, ITEMS[0][1], "x"), (2, None, "x"), (3, "", "x"), (4, f"{long} {ITEMS[1][1]} {long} {ITEMS[4][1]}", "x"), (1, ITEMS[0][1], "x"), (None, ITEMS[2][1], "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([*ITEMS, (7, ITEMS[0][1]), (8, None), (9, "")], "item_id bigint, text string")
    want = {(1, 0), (1, 7), (4, 1), (4, 4), (None, 2)}
    for size in (2_000_000, 100):
        got = L.leaks(df, items, block_words=size)
        assert got.columns == ["doc_id", "item_id"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert L.leaks(df.limit(0), items).count() == 0 and L.leaks(df, items.limit(0)).count() == 0


def test_remarks_across_lines_and_of_any_length():
    item = [f"w{chr(97 + k)}x" for k in range(15)]
    m = L.Matcher([(0, " ".join(item))])
    long = "and they said it again and again " * 12
    for remark in (
        "- Ich bitte um \nRuhe! -", "–\nSilence, please!\n–", f"– We heard {long} today! –", f"({long})", f"[Ivaro Lor: {long}]", "– No final mark here at all –", f"– We heard {long} –",
        "(Loud protest (from the left side) of the house and cries (again (and again)) of shame)", "[Dovar (CL): That is (really [quite]) not true at all!]", "（Applause from the left side of it）",
        "(A b c d e.) – F g h i j! – [K l m n o p]", "—Order, order, order in here!—", "(stray ] inside of a remark here)",
    ):
        assert m.find(" ".join(item[:8]) + f" {remark} " + " ".join(item[8:])) == [0], remark
        assert m.find(" ".join(item[:2]) + f" {remark} " + " ".join(item[2:5]) + f" {remark} {remark} " + " ".join(item[5:])) == [0], remark
    # without any sign of a sentence, but apart from other dashes
    assert m.find(" ".join(item[:8]) + f" – loud cries from the left, {long} – " + " ".join(item[8:])) == [0]
    # brackets that are no remark, around a passage with one
    assert m.find("see (a " + " ".join(item[:8]) + " (Applause.) " + " ".join(item[8:]) + " b)") == [0]
    assert m.find("see (a " + "unclosed " * 40 + " ".join(item[:8]) + " – Silence! – " + " ".join(item[8:]) + " b)") == [0]


def test_each_remark_is_passed_over_or_read_by_itself():
    item = [f"w{chr(97 + k)}x" for k in range(18)]
    own = " ".join(item[:9]) + " (" + " ".join(item[9:13]) + ") " + " ".join(item[13:])
    m = L.Matcher([(0, own)])
    assert m.find(own) == [0]
    assert m.find(" ".join(item[:5]) + " (Loud applause from the left side) " + own.split(item[4])[1]) == [0]
    assert m.find(own.replace(item[15], item[15] + " – Silence, please, all of you! –")) == [0]
    assert m.find(own.replace(") ", ") (Loud applause from the left) ")) == [0]


def paths(w, jumps):
    """Every reading of a text: each remark passed over or read."""
    out, todo = [], [(0, ())]
    while todo:
        at, got = todo.pop()
        if at == len(w):
            out.append(list(got))
            continue
        todo.append((at + 1, (*got, w[at])))
        todo += [(t, got) for t in jumps.get(at, ())]
    return out


@pytest.mark.parametrize("seed", range(8))
def test_remarks_are_the_brute_force(seed):
    r = random.Random(seed)
    item = [r.choice(VOCAB) for _ in range(22)]
    m = L.Matcher([(0, " ".join(item))])
    a = r.randrange(0, 5)
    z = a + r.choice([13, 14, 15, 16, 17])
    body = edited(item[a:z], r.choice([0, 1, 2, 2, 3])).split()
    for remark in ("(one two (three) four)", "– five six –", "[seven eight nine]")[: r.randrange(1, 4)]:
        body.insert(r.randrange(1, len(body)), remark)
    text = f"{noise(2)} {' '.join(body)} {noise(2)}"
    w, jumps = L.parse(text)
    want = any(
        distance(item[x:y], reading) * 6 <= y - x for reading in paths(w, L.Jumps(jumps).on) for x in range(len(item)) for y in range(x + 14, len(item) + 1)
    )
    assert (m.find(text) == [0]) == want


def test_edits_at_the_ends_count_like_others():
    item = L.words(ITEMS[0][1])
    m = L.Matcher(ITEMS)
    # 14 item words of which the last two are lost; of 11 words no such passage can be made
    assert m.find(" ".join(item[:12])) == [0] and m.find(" ".join(item[:11])) == []


def test_many_brackets_and_dashes_take_little_time():
    m = L.Matcher(ITEMS)
    item = ITEMS[0][1]
    for text in ("(" * 3000 + item, "(a) " * 3000 + item, "(" * 2000 + "a" + ")" * 2000 + item, "– a " * 3000 + item, "[(" * 2000 + item + ")]" * 2000):
        assert m.find(text) == [0]
