import collections
import random
import re
import zlib

from tracehull.llm import line_templates as lt, quality_cascade as qc

from . import helpers


def plain_report(rows, md=lt.MIN_DOCS, depth=lt.DEPTH, mf=lt.MIN_FIXED, fp=lt.FIXED_PERCENT):
    docs = sorted({r for r in rows if r[1]}, key=lambda r: (r[0] is not None, r[0] or 0, lt._signed(lt.xxh64_intdigest(r[1].encode()))))
    seen_in, leaf_docs, occurrences = collections.defaultdict(set), collections.defaultdict(set), []
    for d in docs:
        for place, line in enumerate(d[1].split("\n")):
            w = tuple("<*>" if re.search("[0-9]", x) else x for x in helpers.words(line))
            if w:
                occurrences.append((d, place, w))
                seen_in[w].add(d)
                leaf_docs[len(w), w[:depth]].add(d)
    held = {k for k, v in leaf_docs.items() if len(v) >= md}
    support = collections.Counter()
    for w, v in seen_in.items():
        if (len(w), w[:depth]) in held and len(w) >= max(mf, depth + 1):
            for i in range(depth, len(w)):
                if w[i] != "<*>":
                    support[len(w), w[:depth], i, w[i]] += len(v)
    shapes, totals = {}, collections.Counter()
    for w, v in seen_in.items():
        leaf = (len(w), w[:depth])
        fixed = [i for i in range(depth, len(w)) if w[i] != "<*>" and support[(*leaf, i, w[i])] >= md]
        if leaf in held and len(w) >= max(mf, depth + 1) and fixed:
            t = tuple(w[i] if i < depth or i in fixed else "<*>" for i in range(len(w)))
            n = sum(x != "<*>" for x in t)
            if n >= mf and 100 * n >= fp * len(t):
                shapes[w] = t
                totals[leaf, t] += len(v)
    final = {}
    for w, v in seen_in.items():
        leaf = (len(w), w[:depth])
        if leaf in held:
            if w in shapes and totals[leaf, shapes[w]] >= md:
                final[w] = (leaf, shapes[w])
            elif len(v) >= md:
                final[w] = (leaf, w)
    seen, drop = set(), collections.defaultdict(set)
    for d, place, w in occurrences:
        if w in final:
            if final[w] in seen:
                drop[d].add(place)
            seen.add(final[w])
    out = collections.Counter()
    for i, t in rows:
        gone = drop.get((i, t), ())
        kept = "" if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
        out[i, 0 if t is None else t.count("\n") + 1, len(gone), len(kept), zlib.crc32(kept.encode())] += 1
    return out


def made_rows():
    rng = random.Random(3)
    some = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]
    rows = []
    for i in range(60):
        lines = [f"User {i} logged in from host {rng.choice(some)} at noon", f"Session id {rng.choice(some)} opened by the same user on port {i}", " ".join(rng.choice(some) for _ in range(7)), rng.choice(["", "  ", "short", "two words"])]
        rng.shuffle(lines)
        rows.append((i if i % 20 else None, "\n".join(lines)))
    return [*rows, rows[3], (70, None), (71, ""), (72, "\n\n")]


def test_line_report_against_plain_version(spark):
    for rows in (made_rows(), [r[:2] for r in helpers.awkward_rows()]):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert helpers.count(lt.line_report(df).collect()) == plain_report(rows)
    assert lt.line_report(helpers.nothing(spark)).count() == 0


def test_templates_go_but_for_the_first(spark):
    df = spark.createDataFrame(made_rows(), "doc_id long, text string")
    kept = [line for r in lt.drop_templates(df).collect() if r.text for line in r.text.split("\n")]
    assert sum("logged in from host" in x for x in kept) < 10
    dropped = [line for r in lt.drop_templates(df, keep_first=False).collect() if r.text for line in r.text.split("\n")]
    assert not any("logged in from host alpha" in x for x in dropped)


def test_fields_of_common_values_are_variable(spark):
    some = [a + b for a in "abcde" for b in "wxyz"]
    for size, other in ((10, 0), (20, 0), (20, 1500)):  # the last in a leaf of mostly other lines
        rows = [(i, f"Please ask our name{some[i % size]} at the city{some[i // size]} office for further help") for i in range(size * size)]
        rng = random.Random(size)
        rows += [(5000 + i, "Please ask our " + " ".join("w" + rng.choice("abcdefghijklmnop") + rng.choice("abcdefghijklmnop") for _ in range(9))) for i in range(other)]
        got = lt.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sum(r.n_dropped for r in got if r.doc_id < 5000) == size * size - 1 and not any(r.n_dropped for r in got if r.doc_id >= 5000)


def test_long_lines_recur_from_two_documents_on(spark):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(55))
    numbers = [" ".join(str(100 * k + i) for i in range(55)) for k in range(3)]  # alike but for digits: not the same
    short = " ".join(long.split()[:40])
    rows = [(1, f"one a\n{long}\nx"), (2, f"two b\n  {long}\ny"), (3, f"{long} more\n{short}"), (4, short), (5, numbers[0]), (6, numbers[1]), (7, numbers[2]), (8, f"z\n{numbers[2]}"), (9, f"{long} twice\n{long} twice"), (10, f"v 1\n{short} 5"), (10, f"v 1\n{short} 5")]
    got = {r.doc_id: r.n_dropped for r in lt.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, k in got.items() if k} == {2, 8} and got[2] == got[8] == 1


def test_lines_of_one_document_count_once(spark):
    some = ["oak", "elm", "ash", "fir", "yew", "box"]
    listed = "\n".join(f"Please plant the tall {w} beside the old stone wall today" for w in some)
    leaf = [(i, f"Please plant the {' '.join(a + str(chr(97 + i)) for a in 'abcdefgh')}") for i in range(2, 9)]
    for copies, dropped in ((1, 0), (4, 0), (5, 4 * 6)):  # of five, each line keeps its first
        rows = [*leaf, *((20 + i, listed + "\nn" + "o" * i) for i in range(copies))]
        got = lt.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sum(r.n_dropped for r in got) == dropped


def test_stage_keeps_columns(spark):
    docs = helpers.awkward(spark)
    out = lt.drop_templates(docs)
    assert out.columns == docs.columns and out.count() <= docs.count()
    assert all(r.n_chars == len(r.text) for r in out.where("text IS NOT NULL AND doc_id < 100").collect())


def plain_counts(text):
    ws = helpers.words(text)
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    times = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if helpers.words(x)]
    n = len(ws)
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_counts(spark):
    rng = random.Random(9)
    rows = helpers.awkward_rows() + [(300 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))), None, None, 0, 0, "", "", "") for i in range(40)]
    rows += [(400 + i, " ".join(f"w{rng.randint(0, 12)}" for _ in range(200)) + "\n#a\n#a", None, None, 0, 0, "", "", "") for i in range(10)]
    df = spark.createDataFrame(rows, helpers.SCHEMA)
    got = qc.quality(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert helpers.count(got) == helpers.count((r[0], *plain_counts(r[1])) for r in rows)
    assert qc.quality(helpers.nothing(spark)).count() == 0


def test_cascade_verdict_does_not_depend_on_order(spark):
    prose = " ".join(f"wörter{i} and" for i in range(60))
    texts = [prose, prose.upper(), " ".join(w + "%%%" for w in prose.split()), " ".join(w + "!!" for w in prose.split()), "1 2 3 4 5 6 7 8 9 0 " * 10 + prose, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rules = qc.default_rules()
    forward = {r.doc_id for r in df.where(qc.first_failure(rules).isNull()).collect()}
    backward = {r.doc_id for r in df.where(qc.first_failure(rules[::-1]).isNull()).collect()}
    assert forward == backward and 0 in forward and not {1, 2, 3, 4} & forward
    assert {r.doc_id for r in qc.cascade(df).collect()} == forward
    assert len(qc.order_rules(df, rules)) == len(rules)


def test_rules_are_ordered_by_rejections_among_the_rest_a_cost(spark):
    # rule 0 rejects most but is dear; 1 is cheap; 2 rejects only what 1 does; 3 rejects nothing and is the cheapest
    patterns = {0b0000: 50, 0b0001: 30, 0b0011: 5, 0b0110: 20, 0b0111: 5}
    assert qc.greedy_order(patterns, [8.0, 1.0, 0.9, 0.1]) == [1, 0, 3, 2]
    assert qc.greedy_order(patterns, [0.5, 1.0, 1.0, 1.0]) == [0, 1, 2, 3]
    texts = ["a" * 30 + " b"] * 30 + ["A B C"] * 20 + ["fine words here"] * 50
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 8)], "doc_id long, text string")
    rules = [qc.Rule("dear", qc.F.col("text") == "A B C"), qc.Rule("long", qc.F.length("text") > 20), qc.Rule("never", qc.F.length("text") < 0)]
    for _ in range(3):
        assert [r.name for r in qc.order_rules(df, rules, costs=[100.0, 1.0, 1.0])] == ["long", "dear", "never"]
    slow = qc.Rule("slow", qc.F.length(qc.F.regexp_replace(qc.F.repeat("text", 200), "[aeiou]+(?=x)", "")) < 0)
    cost = qc.rule_costs(df.cache(), [qc.Rule("quick", qc.F.length("text") < 0), slow])
    assert cost[0] < cost[1]


def test_quality_runs_no_python(spark):
    plan = qc.quality(helpers.awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
