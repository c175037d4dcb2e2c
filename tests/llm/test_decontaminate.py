import re

from leadmill.llm import decontaminate
from leadmill.llm.queries import QUERIES


def template(text):
    """Template and values in plain Python."""
    tokens = re.findall(r"\d+(?:[.,]\d+)*|[^\W\d_]+[.!?]?|[%$€£°]", text or "")
    kinds, values = [], []
    for i, t in enumerate(tokens):
        word = t.rstrip(".!?").lower()
        before = tokens[i - 1] if i else ""
        if t[0].isdigit():
            kinds.append("<num>")
        elif before[:1].isdigit() and word in decontaminate.UNITS:
            kinds.append("<unit>")
        elif i and t[0] != t[0].lower() and before[-1] not in ".!?":
            kinds.append("<name>")
        else:
            kinds.append(word)
        values.append(word)
    return kinds, values


def contains(doc, item):
    """(windows found, windows) of an item; found counts only consistent alignments."""
    w = decontaminate.WINDOW
    (dk, dv), (ik, iv) = template(doc), template(item)
    eligible = [p for p in range(len(ik) - w + 1)
                if sum(not k.startswith("<") for k in ik[p : p + w]) >= decontaminate.MIN_WORDS]
    shifts = {}
    for p in eligible:
        for d in range(len(dk) - w + 1):
            if dk[d : d + w] == ik[p : p + w]:
                shifts.setdefault(d - p, []).append(p)
    found = set()
    for shift, ps in shifts.items():
        seen, torn = {}, False
        for p in ps:
            for k in range(p, p + w):
                if ik[k].startswith("<"):
                    torn |= seen.setdefault(iv[k], dv[k + shift]) != dv[k + shift]
        if not torn:
            found |= set(ps)
    return len(found), len(eligible)


ITEM = "A train leaves Paris at 9 and Anna pays 20 euros for it. Later Anna gives 20 euros back to him."
OTHER = "A train leaves London at 7 and Bert pays 35 euros for it. Later Bert gives 35 euros back to him."
TORN = "A train leaves London at 7 and Bert pays 35 euros for it. Later Carl gives 99 euros back to him."


def test_other_values_are_caught_if_consistent(spark):
    docs = spark.createDataFrame(
        [(1, "before it. " + ITEM + " After it.", 0), (2, "so. " + OTHER, 0), (3, "so. " + TORN, 0),
         (4, None, 0), (5, "", 0), (6, "short text", 0), (7, "word " * 20000, 0),
         (None, ITEM, 0), (1, "before it. " + ITEM + " After it.", 0)],
        "doc_id long, text string, item_id int",
    )
    bench = spark.createDataFrame(
        [(1, ITEM, "x"), (1, ITEM, "x"), (2, None, "x"), (3, "too short", "x"), (None, ITEM, "x")],
        "item_id long, text string, doc_id string",
    )
    rows = decontaminate.find(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.values_kept) for r in rows) == [
        (0, 1, True), (1, 1, True), (2, 1, False),
    ]
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7]
    assert decontaminate.find(docs.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_query_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    want = set()
    for d in docs:
        grams = set(zip(*[template(d.text)[0][k:] for k in range(decontaminate.WINDOW)]))
        for i in items:
            if grams.isdisjoint(zip(*[template(i.text)[0][k:] for k in range(decontaminate.WINDOW)])):
                continue
            found, all_ = contains(d.text, i.text)
            if all_ and found >= decontaminate.COVERAGE * all_:
                want.add((d.doc_id, i.item_id, found, all_))
    rows = QUERIES["op5_decontamination"](spark, sf_dir).collect()
    assert {(r.doc_id, r.item_id, r.windows_found, r.item_windows) for r in rows} == want
    # Every item that stands in a document word for word is found.
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    verbatim = {(d.doc_id, i.item_id) for d in docs for i in items if plain(i.text) in plain(d.text)}
    assert verbatim <= {w[:2] for w in want}
