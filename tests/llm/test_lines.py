"""Line dedup against a plain loop over all documents."""

import difflib
import random
from collections import Counter

from corpusloom.llm import line_alignment as la

DDL = "doc_id long, text string, row string, name long"


def corpus():
    rng = random.Random(6)
    line = lambda: "".join(rng.choices("abcdefgh ", k=rng.randint(5, 60)))
    pool = [line() for _ in range(30)]
    docs = []
    for i in range(120):
        lines = [rng.choice(pool) if rng.random() < 0.3 else line() for _ in range(rng.randint(1, 15))]
        if i > 20 and rng.random() < 0.4:  # a copy with changes
            lines = docs[rng.randrange(i)][1].split("\n")
            for _ in range(rng.randint(0, 3)):
                lines.insert(rng.randrange(len(lines) + 1), line())
        docs.append((i, "\n".join(lines), "x", 1))
    return docs


def brute(docs, rare_df, min_chars):
    named = []
    for d, text, *_ in docs:
        lines, found = la.units(text or "", min_chars)
        seen, out = {}, []
        for k, (a, e, at) in enumerate(found):
            s = lines[at].strip()
            seen[s] = seen.get(s, 0) + 1
            out.append(((s, seen[s]), k, (lines[a:at], lines[at + 1 : e])))
        named.append((d, out))
    kept = {}
    for (d, out), (_, text, *_) in zip(named, docs):
        pairs = {}
        dfs = {}
        for name, k, around in out:
            holders = [(e, k2, ar2) for e, o2 in named for n2, k2, ar2 in o2 if n2 == name]
            e, k2, ar2 = min(holders, key=lambda h: h[0])
            if e < d:
                dfs[name] = len(holders)
                pairs.setdefault(e, []).append((name, k, k2, around == ar2))
        gone = []
        for e, rows in pairs.items():
            if min(dfs[r[0]] for r in rows) <= max(rare_df, min(dfs.values())):
                best = [0] * len(rows)
                for i in range(len(rows)):
                    best[i] = 1 + max((best[j] for j in range(i) if rows[j][2] < rows[i][2]), default=0)
                keep = la.rising([r[2] for r in rows])
                assert len(keep) == max(best)
                gone += [rows[i][1] + 1 if rows[i][3] else -rows[i][1] - 1 for i in keep]
        kept[d] = la.remaining(text or "", sorted(gone, key=abs), min_chars)
    return kept


def test_against_loops(spark):
    docs = corpus()
    for rare_df in (3, 1000):
        got = la.dedup(spark.createDataFrame(docs, DDL), rare_df, 20).collect()
        want = brute(docs, rare_df, 20)
        assert {r.doc_id: (r.kept, r.n_lines, r.n_removed, r.n_blocks) for r in got} == want
    assert sum(w[2] for w in want.values()) > 100


def test_copies_edits_and_odd_rows(spark):
    base = ["line number %d of the first document here" % i for i in range(8)]
    text = "\n".join(["Top", *base[:4], "", "--", *base[4:]])
    edited = "\n".join([*base[:3], "something new that nobody else ever wrote", *base[3:]])
    docs = [(1, text), (2, text), (2, text), (3, edited), (4, None), (5, ""), (None, text), (6, "short\nlines"), (7, "short\nlines")]
    docs += [(100 + i, text) for i in range(50)]
    got = la.dedup(spark.createDataFrame([(*d, "x", 2) for d in docs], DDL), rare_df=5).collect()
    assert len(got) == len(docs)
    kept = {}
    for r in got:
        kept.setdefault(r.doc_id, set()).add(r.kept)
    assert kept[1] == {text} and kept[None] == {text} and kept[2] == {""}
    assert kept[3] == {"something new that nobody else ever wrote"}
    assert all(kept[100 + i] == {""} for i in range(50))
    assert kept[4] == kept[5] == {""} and kept[6] == kept[7] == {"short\nlines"}


def test_lines_of_any_frequency_found_pairs(spark):
    passage = "\n".join("line %d of a passage that very many documents share" % i for i in range(3))
    rare = "a line that only two of the documents have in common"
    docs = [(i, f"text {i} that this document has for itself\n{passage}", "x", 1) for i in range(1100)]
    docs += [(2000, f"another opening that nobody shares\n{rare}", "x", 1), (2001, f"{passage}\n{rare}", "x", 1)]
    got = {r.doc_id: r.kept for r in la.dedup(spark.createDataFrame(docs, DDL)).collect()}
    assert got[2001] == "" and all(got[i] == docs[i][1].split("\n")[0] for i in range(1, 1100))


def test_copies_of_documents_with_moved_sections(spark):
    x, y, z = (["line %d of section %s in all versions" % (i, s) for i in range(n)] for s, n in (("x", 4), ("y", 3), ("z", 2)))
    versions = [x + y + z, y + x + z, z + y + x]
    docs = [(10 * v + k, "\n".join(lines), "x", 1) for v, lines in enumerate(versions) for k in range(3)]
    for shown in (la.dedup(spark.createDataFrame(docs, DDL), whole=True), la.without_repeats(spark.createDataFrame(docs, DDL)).withColumnRenamed("text", "kept")):
        got = {r.doc_id: r.kept for r in shown.collect()}
        assert got[0] == docs[0][1] and not any(got.get(10 * v + k) for v in range(3) for k in (1, 2))
    assert got[10] == "\n".join(y)


def test_passages_of_short_lines(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 9)))
    verse, opening = [word() for _ in range(60)], "a long line that each of the texts has around here"
    texts = ["\n".join(verse), "\n".join(verse), "\n".join(["own", "words", *verse, "and", "an end"]), "\n".join([opening, "else", *verse[5:50], "other"]), "\n".join(["", *verse[:9], "", *verse[9:], ""]), "吾輩は猫である。\n名前はまだ無い。\nどこで生れたか\nとんと見当がつかぬ。", "前\n吾輩は猫である。\n名前はまだ無い。\nどこで生れたか\nとんと見当がつかぬ。"]
    for i in range(40):
        lines, found = la.runs("\n".join(rng.choices(["", "a", "abcdefgh", " long enough to be an anchor of its own "], k=i)), 20)
        assert all(first <= at < to <= end and len("".join(x.strip() for x in lines[at:to])) >= 20 for first, end, at, to in found)
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DDL)
    got = {r.doc_id: r.kept for r in la.dedup(rows, whole=True).collect()}
    assert [got[0], got[1], got[2], got[3], got[5], got[6]] == [texts[0], "", "own\nwords\nand\nan end", f"{opening}\nelse\nother", texts[5], "前"]
    assert len(got[4].split()) < 9
    assert {r.doc_id for r in la.without_repeats(rows).collect()} == {0, 2, 3, 4, 5, 6} - ({4} if not got[4].strip() else set())


def test_patience_agrees_with_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(50):
        a, b = rng.sample(range(30), 20), rng.sample(range(30), 20)
        common = [x for x in b if x in a]
        n = len(la.rising([a.index(x) for x in common]))
        assert n >= sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def test_empty(spark):
    assert la.digests(spark.createDataFrame([], DDL)).count() == 0


def test_short_lines_of_exact_copies_go_though_their_neighbour_is_held_elsewhere(spark):
    a, b = "a line of thirty characters or so", "another line of thirty characters"
    docs = [(0, a, "x", 1), (1, f"{a}\nhi\n{b}", "x", 1), (2, f"{a}\nhi\n{b}", "x", 1), (3, f"{a}\nhi\n{b}", "x", 1)]
    got = {r.doc_id: r.kept for r in la.dedup(spark.createDataFrame(docs, DDL), whole=True).collect()}
    assert got == {0: a, 1: f"hi\n{b}", 2: "", 3: ""}


def test_whole_form_against_what_it_must_do(spark):
    docs = corpus()
    docs += [(500 + i, docs[i * 3][1], "x", 1) for i in range(30)]  # exact copies
    got = {r.doc_id: r for r in la.dedup(spark.createDataFrame(docs, DDL), whole=True).collect()}
    earlier: set[str] = set()
    texts: set[str] = set()
    for d, text, *_ in docs:
        lines, kept = text.split("\n"), got[d].kept.split("\n") if got[d].n_removed < got[d].n_lines else []
        rest = iter(lines)
        assert all(line in rest for line in kept)  # what is kept stands in its order
        gone = Counter(x.strip() for x in lines) - Counter(x.strip() for x in kept)
        assert all(x in earlier for x in gone)  # what is deleted, an earlier document has
        assert got[d].n_removed == len(lines) - len(kept)
        if text in texts and len("".join(lines)) >= 20:
            assert not got[d].kept.strip(), d
        long = {x.strip() for x in lines if len(x.strip()) >= 20}
        counts = Counter(x.strip() for x in kept if len(x.strip()) >= 20)
        assert not [x for x, n in counts.items() if n == 1 and x in long & earlier and lines.count(x) == 1 and len(long) == 1]
        earlier |= {x.strip() for x in lines}
        texts.add(text)
