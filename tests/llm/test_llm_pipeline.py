"""Every stage of the pipeline against plain Python, on documents with planted cases."""

import random

import pytest
import regex

import corpus_pipeline
from forecourt.llm.common import table, written
from forecourt.llm.decontaminate import contaminated

_draw = random.Random(31)
_BLANKS = " \t\n\x0b\f\r"
_UNIT_END = regex.compile(
    r"(?<=[.!?][\"'”’)»\]]?[^\S\n]{1,4})(?=\S)"
    r"|(?<=[。！？])(?=[^\s。！？])"
    r"|(?<=\n)(?=[^\S\n]*\S)", regex.ASCII)


def without_passages(texts, words=50):
    """``texts`` in order, without units that lie in a run of over 50 words that came before."""
    seen, out = set(), []
    for text in texts:
        cuts = [0, *(m.start() for m in _UNIT_END.finditer(text)), len(text)]
        parts = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        bare = [p.rstrip(_BLANKS) for p in parts]
        sizes = [len(regex.findall(r"\S+", p, regex.ASCII)) for p in parts]
        gone = set()
        for b in range(len(parts)):
            own, total = [], 0
            for a in range(b, -1, -1):
                total += sizes[a]
                if total > words:
                    run = tuple(bare[a:b + 1])
                    if run in seen:
                        gone |= set(range(a, b + 1))
                    own.append(run)
                    if total > 4 * words:  # longer ones hold shorter ones
                        break
            seen.update(own)
        stay, left = [i for i in range(len(parts)) if i not in gone], ""
        for k, i in enumerate(stay):
            left += parts[i]
            following = stay[k + 1] if k + 1 < len(stay) else i + 1
            if not parts[i].endswith("\n") and any(p.endswith("\n") for p in parts[i + 1:following]):
                left += "\n"
        out.append((left.rstrip(_BLANKS) or None) if gone else text)
    return out


def near_groups(texts):
    """The smallest key reachable over pairs of texts whose word shingles are alike to 0.75."""
    sets = {}
    for key, text in texts.items():
        words = regex.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[key] = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    above = {k: k for k in sets}

    def root(k):
        while above[k] != k:
            k = above[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                above[y] = x
    return {k: root(k) for k in keys}


def tile_coverage(item, doc, shortest):
    """Words of the item in tiles, the longest run of open words first."""
    open_item, open_doc, covered = [True] * len(item), [True] * len(doc), 0
    places = {}
    for j, w in enumerate(doc):
        places.setdefault(w, []).append(j)
    while True:
        best = (shortest - 1, 0, 0)
        for i, w in enumerate(item):
            for j in places.get(w, ()):
                n = 0
                while (i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n]
                       and open_item[i + n] and open_doc[j + n]):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < shortest:
            return covered
        open_item[i:i + n] = [False] * n
        open_doc[j:j + n] = [False] * n
        covered += n


def _words(text):
    return regex.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def plain_hits(docs, items, shortest=5, share=0.6):
    found = {}
    for d, text in docs.items():
        words = _words(text)
        runs = {tuple(words[i:i + n]) for n in range(1, shortest + 1) for i in range(len(words) - n + 1)}
        for i, item in items.items():
            its = _words(item)
            n = min(shortest, len(its))
            if its and any(tuple(its[k:k + n]) in runs for k in range(len(its) - n + 1)):
                covered = tile_coverage(its, words, n)
                if covered >= share * len(its):
                    found[d, i] = covered
    return found


def _sentence(n):
    return " ".join(f"w{_draw.randrange(10**6)}" for _ in range(n)) + "."


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """The smallest tables, with planted copies, passages, benchmark items, and odd rows."""
    path = str(tmp_path_factory.mktemp("planted"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    prose = [r.text for r in docs.where("n_chars BETWEEN 1500 AND 4000 AND lang = 'en'").limit(12).collect()]
    some = [t for t in items.values() if len(_words(t)) >= 24][:6]
    passage = " ".join(_sentence(13) for _ in range(5))
    texts = [prose[0], prose[0] + " One more sentence at the end of it.", prose[1].replace(" the ", " a ")]
    texts += [f"{prose[i]}\n{passage}\n{prose[i + 1]}" for i in (2, 4)]
    half = [(" ".join(w[len(w) // 2:]), " ".join(w[:len(w) // 2])) for w in (t.split() for t in some)]
    texts += [f"{prose[6]} {b} {prose[7]} {a}" for b, a in half[:3]]  # in another order
    texts += [f"{prose[8]} {b[:len(b) // 2]} {prose[9]}" for b, _ in half[3:]]  # too little
    texts += [_sentence(90), "", None, " \n ", prose[10]]
    planted = spark.createDataFrame(
        [(10_000 + i, t, "en", "planted", None) for i, t in enumerate(texts)], docs.schema)
    docs.union(planted).repartition(3).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path


def test_every_stage_is_its_plain_version(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, folder, "documents")
    labels = dict(map(tuple, table(spark, folder, "labels").select("doc_id", "quality").collect()))

    judged = written(stages["quality classifier"](spark, docs, folder), "judged")
    assert judged.columns == corpus_pipeline.COLUMNS
    kept = {r.doc_id for r in judged.collect()}
    good, bad = ([d for d, label in labels.items() if label == x] for x in (1, 0))
    # Learnt from some sixty labels.
    assert sum(d in kept for d in good) >= 0.95 * len(good)
    assert sum(d in kept for d in bad) <= 0.1 * len(bad)

    before = {r.doc_id: r.text for r in judged.collect()}
    lined = written(stages["line dedup"](spark, judged, folder), "lined")
    after = {r.doc_id: r for r in lined.collect()}
    order = [d for d in sorted(before) if before[d] is not None]
    expected = dict(zip(order, without_passages([before[d] for d in order])))
    assert {d: r.text for d, r in after.items()} == {
        d: expected.get(d) for d in before if d not in expected or expected[d] is not None}
    assert all(r.n_chars == len(r.text) for r in after.values() if r.text != before[r.doc_id])
    assert sum(after[d].text != before[d] for d in after) >= 2

    alone = written(stages["MinHash near-dedup"](spark, lined, folder), "alone")
    groups = near_groups({d: r.text for d, r in after.items()})
    assert {r.doc_id for r in alone.collect()} == {d for d, low in groups.items() if d == low}

    texts = {r.doc_id: r.text for r in alone.collect()}
    items = {r.item_id: r.text for r in table(spark, folder, "benchmark").collect()}
    clean = written(stages["benchmark decontamination"](spark, alone, folder), "clean")
    hits = plain_hits(texts, items)
    assert {r.doc_id for r in clean.collect()} == set(texts) - {d for d, _ in hits}

    packed = stages["packing"](spark, clean, folder).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean.collect()}
    whole = {}
    for r in packed:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
    assert all(whole[r.doc_id] == r.doc_tokens for r in packed)


def test_items_found_are_those_of_plain_tiling(spark, folder):
    """Both ways: whole, partly covered and reordered items, and none that is below the share."""
    docs = table(spark, folder, "documents")
    items = table(spark, folder, "benchmark")
    got = {(r.doc_id, r.item_id): r.covered for r in contaminated(docs, items).collect()}
    wanted = plain_hits({r.doc_id: r.text for r in docs.collect()},
                        {r.item_id: r.text for r in items.collect()})
    assert got == wanted
    reordered = {d for d, _ in got if d >= 10_000}
    assert len(reordered) >= 3


def test_run_is_the_stages_in_turn(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "ids", "sequence_id", "offset"} <= set(rows.columns)
    assert rows.count() > 0


def test_a_filter_on_the_text_does_not_split_it_again(spark, folder):
    """The last job of the line stage cuts each text a fixed number of times, filtered or not."""
    from forecourt.llm.line_dedup import drop_repeated_passages

    frame = drop_repeated_passages(table(spark, folder, "documents"))

    def splits(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("split(text")

    # One for the text, one for the filter; none for each of its units.
    assert splits(frame.select("text")) == 1
    assert splits(frame.where("text IS NOT NULL").select("text")) <= 2
