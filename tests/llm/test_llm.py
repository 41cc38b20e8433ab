"""Training-data operators against brute force, and their edge cases."""

import random
import re
import sys
from itertools import combinations
from math import comb, log

import numpy as np
import pytest
from oracle import compare

from blockwise.llm import consistent, distinctive, leakage, names, packing, pairs, quality, queries, set_pairs, splitting


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_sql(spark, data, name):
    compare(spark, data, queries.QUERIES[name], queries.SQL[name])


# ---- splitting


def prompt(sizes, sep="\n\n"):
    return sep.join(["Group these."] + [f"[record_index {i}]\nTitle: " + "word " * n for i, n in enumerate(sizes)])


@pytest.mark.parametrize("sep", ["\n\n", "\n---\n", "\r\n\r\n"])
def test_split_keeps_limit_text_and_overlap(sep):
    t = prompt([30, 20, 45, 10, 400, 25, 30, 35, 20], sep)
    limit, over = 100, 2
    out = splitting.split_text(t, limit, over)
    assert out[0][0] == 0 and out[-1][1] == len(t)
    heads = [m.start() for m in splitting.RECORD.finditer(t)]
    for (s, e, lv), (s2, _, _) in zip(out, out[1:]):
        assert s2 <= e and (e - s) // 4 <= limit
        if lv:
            assert heads[4] < e < heads[5]
    cuts = [e for _, e, lv in out[:-1] if lv == 0]
    assert all(c in heads for c in cuts)
    last = [i for i, (s, e, lv) in enumerate(out[:-1]) if lv == 0 and e > heads[6]]
    assert all(sum(out[i + 1][0] <= h < out[i][1] for h in heads) >= 1 for i in last)


@pytest.mark.parametrize("body", ["x" * 4000, "\n".join(["word" * 38] * 25), "\n".join(["some words " * 14] * 25), "字" * 150 + "\r\n" + "y" * 3000])
def test_split_inside_a_record_repeats_something(body):
    t = prompt([10, 10]) + "\n\n[record_index 2]\n" + body + "\n\n[record_index 3]\nend"
    limit = 100
    out = splitting.split_text(t, limit, 1)
    assert out[0][0] == 0 and out[-1][1] == len(t) and all((e - s) // 4 <= limit for s, e, _ in out)
    inner = [(e, n[0]) for (s, e, lv), n in zip(out, out[1:]) if lv]
    assert len(inner) > 5 and all(0 < e - s <= limit for e, s in inner)


def test_split_is_optimal_for_records():
    t = prompt([20] * 9)
    limit = 120
    out = splitting.split_text(t, limit, 0)
    edges = [0, *[m.start() for m in splitting.RECORD.finditer(t)], len(t)]
    cap = 4 * limit + 3

    def cost(cut):
        at = [0, *cut, len(t)]
        if any(b - a > cap for a, b in zip(at, at[1:])):
            return float("inf")
        return sum(splitting.PIECE + ((cap - (b - a)) / cap) ** 2 for a, b in zip(at, at[1:]))

    best = min(cost(c) for k in range(len(edges)) for c in combinations(edges[1:-1], k))
    assert cost([e for _, e, _ in out[:-1]]) == pytest.approx(best)


@pytest.mark.parametrize("text", ["", "x", "x" * 5000, "\n" * 3000, "é" * 999 + " " + "字" * 4000, "[record_index 0]" * 400])
def test_split_odd_texts(text):
    out = splitting.split_text(text, 50, 3)
    assert out[0][0] == 0 and out[-1][1] == len(text) and all((e - s) // 4 <= 50 for s, e, _ in out)
    assert all(b <= a2 or a < b for (a, a2, _), (b, _, _) in zip(out, out[1:]))


def test_split_table(spark):
    q = spark.createDataFrame([(1, "m", prompt([60] * 5), "z"), (1, "m", prompt([60] * 5), "z"), (2, "m", "", "z"), (3, None, "x", "z"), (4, "m", None, "z"), (5, "other", "x", "z")], "request_id long, model string, prompt string, piece_no string")
    lim = spark.createDataFrame([("m", 100, None, 1), ("m", 100, None, 1)], "model string, prompt_limit int, overlap_records int, text int")
    got = splitting.split_oversized(q, lim).collect()
    assert {r.request_id for r in got} == {1, 2} and sum(r.request_id == 2 for r in got) == 1
    assert len({r.piece_no for r in got if r.request_id == 1}) == sum(r.request_id == 1 for r in got) > 1
    assert splitting.split_oversized(q.where("false"), lim).count() == 0


# ---- names


def test_segment_join_equals_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 9))) for _ in range(80)]
    for k in (1, 2):
        df = spark.createDataFrame([("g", w) for w in {*base}], "g string, w string")
        got = {(r.indexed, r.probed) for r in names.segment_join(df, df, "g", "w", k).collect()}

        def dist(a, b):
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                prev, row[0] = row[0], i
                for j, y in enumerate(b, 1):
                    prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
            return row[-1]

        assert got == {(a, b) for a in {*base} for b in {*base} if a != b and len(a) > k and len(b) > k and dist(a, b) <= k}


@pytest.mark.parametrize("low, high", [(3, 9), (2, 5)])
def test_segment_join_with_swaps_equals_brute_force(spark, low, high):
    rng = random.Random(6)
    base = {"".join(rng.choice("abc") for _ in range(rng.randint(low, high))) for _ in range(90)}
    long = {"".join(rng.choice("ab") for _ in range(rng.randint(3, high + 1))) for _ in range(60)}
    for words, k, near in ((base, 1, names._one_edit), (long, 2, lambda a, b: names._typing_errors(a, b) <= 2)):
        df = spark.createDataFrame([(g, w) for w in words for g in "gh"], "g string, w string")
        want = {(g, a, b) for a in words for b in words for g in "gh" if a != b and near(a, b)}
        assert {tuple(r) for r in names.segment_join(df, df, "g", "w", k, swaps=True).collect()} == want
        assert {tuple(r) for r in names.segment_join(df, None, "g", "w", k, swaps=True).collect()} == want


PLACES = ["Bergholm", "Tavastad", "Limdorf", "Quemouth", "Zedwick", "Fulhaven", "Irogard", "Wemville"]
SURNAMES = ["Kuvanen", "Drobesh", "Malinero", "Szeplak", "Ostrover", "Quillabeg", "Hintaru", "Vodanic"]


def entries(spark, rows):
    """The rows and, from id 1000 on, people of another block from whom short forms and spellings can be learnt."""
    more = []
    for i, (p, s) in enumerate(zip(PLACES, SURNAMES)):
        for kind in ("University of {}", "Univ. of {}", "Universty of {}" if i < 3 else "The University of {}", "{} Polytechnic", "{} Hospital"):
            more += [(n.format(s), kind.format(p), "other") for n in ("Tomasz {}", "{}, Tomek")]
    return spark.createDataFrame([*((i, *r) for i, r in enumerate(rows)), *((1000 + i, *r) for i, r in enumerate(more))], "entry_id long, name string, org string, block_name string")


def pairs_of(df):
    return {(r.id_a, r.id_b) for r in df.collect() if r.id_b < 1000}


def test_person_pairs(spark):
    rows = [
        ("Tomasz Lekovar", "University of Oxel", "b"), ("Lekovar, Tomek", "Univ. of Oxel", "b"), ("LEKOVAR T", "The University of Oxel", "b"), ("Tomasz Lekovra", "Universty of Oxel", "b"), ("TOMASZ LEKOVAR", "University of Oxel", "b"),
        ("Ivan Lekovar", "Oxel Polytechnic", "b"), ("Tomasz Lekovar", "Oxel Polytechnic", "b"), ("Anna Mistral", "University of Oxel", "b"), ("Anja Quintel", None, "b"), ("Quintel, Anja", "University of Oxel", "b"),
        (None, "University of Oxel", "b"), ("", None, "b"), ("Pеtra Sоlen", "University of Oxel", "b"), ("Petra Solen", "University of Oxel", "b"), ("Ann Mistrel", "University of Oxal", "b"),
        ("Hans-Peter Berg", "University of Oxel", "b"), ("Hans Peter Berg", "University of Oxel", "b"), ("Berg, H.-P.", "University of Oxel", "b"),
    ]
    df = entries(spark, rows + rows[:1])
    got = pairs_of(names.person_pairs(df.unionByName(df)))
    # the repeated first row has an id of its own
    extra = len(rows)
    want = {(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (8, 9), (1, extra), (2, extra), (3, extra), (15, 16), (15, 17), (16, 17)}
    assert got == want


def test_two_typing_errors_in_a_long_surname(spark):
    rows = [
        ("Kozavekno, G.", "Ox Hospital", "b"), ("Kozaenko, G.", "Ox Hospital", "b"), ("Mikhail Remaylrud", "Ox Hospital", "b"), ("Mikhail Rlmalyrud", "Ox Hospital", "b"), ("Goojapywan, Z.", "Ox Hospital", "b"), ("Gojapywn, Z.", "Ox Hospital", "b"),
        ("Papgurig, Zoe", "Ox Hospital", "b"), ("Papoogurig, Nadia", "Ox Hospital", "b"), ("Kozaenko, G.", "Ox Polytechnic", "b"), ("Mistral, K.", "Ox Hospital", "b"), ("Mostrul", "Ox Hospital", "b"), ("Tivaro, L.", "Ox Hospital", "b"), ("Tevuro, L.", "Ox Hospital", "b"),
    ]
    assert pairs_of(names.person_pairs(entries(spark, rows))) == {(0, 1), (2, 3), (4, 5)}


def test_short_surnames_with_one_given_name(spark):
    rows = [
        ("Wang, Mirela", "Ox Hospital", "b"), ("Wagn, Mirela", "Ox Hospital", "b"), ("Novak, Tomasz", "Ox Hospital", "b"), ("Novk, Tomek", "Ox Hospital", "b"),
        ("Wang, Otto", "Ox Polytechnic", "b"), ("Wagn, Petra", "Ox Polytechnic", "b"), ("Ruiz, K.", "Ox Polytechnic", "b"), ("Ruz, K.", "Ox Polytechnic", "b"), ("Jonas Lind", "Ox Polytechnic", "b"), ("Jonas Lnid", "Ox Polytechnic", "b"),
    ]
    assert pairs_of(names.person_pairs(entries(spark, rows))) == {(0, 1), (2, 3), (8, 9)}


def test_initials_that_fit_several_stay_apart(spark):
    rows = [("Wanda Gukirez", "Ox Hospital", "b"), ("William Gukirez", "Ox Hospital", "b"), ("W. Gukirez", "Ox Hospital", "b"), ("Dr. Wanda Gukirez", "Ox Hospital", "b"), ("W. Gukirze", "Ox Hospital", "b"), ("Nadia Terzapol", "Ox Hospital", "b"), ("N. Terzpol", "Ox Hospital", "b")]
    # the two with initials only differ by a swap and fit two people, so they go with each other only
    assert pairs_of(names.person_pairs(entries(spark, rows))) == {(0, 3), (2, 4), (5, 6)}
    assert names.person_pairs(entries(spark, rows).where("false")).count() == 0


def test_short_forms_are_learnt_and_siblings_are_not(spark):
    rows = [(n, "o", "b", s, g) for s in SURNAMES for n, g in ((s + "1", "roberta"), (s + "2", "bo"))] + [("x", "o", "b", f"s{i}", g) for i in range(6) for g in ("ada", f"g{i}")]
    df = spark.createDataFrame([(a, b, c, s, g, "") for a, b, c, s, g in rows + [("y", "o2", "b", "z", "roberta")]], "name_key string, org_key string, block string, surname string, given string, initials string")
    assert {tuple(r) for r in names.full_given_names(df).collect()} == {("bo", "roberta")}


def test_orgs(spark):
    rows = ["University of Oxel", "U. of Oxel", "Oxel, University of", "Universty of Oxel", "University of Oxal", "Dept. of Law, Oxel Univ.", "Oxel University, Department of Law", "Departmant of Physics, Oxel University", "Oxel Institute of Technology", "Oxel Institute of Theology", "Oxel Inst. Tech.", None, "n/a", "N/A", "", "Oxel Observatory", "Oxel Obs.", "Oxel Observatoy"]
    n = len(rows)
    for i, p in enumerate([a + b for a in ("Berg", "Tava", "Lim", "Que", "Zed", "Ful") for b in ("holm", "stad", "dorf", "mouth", "wick")]):
        rows += [f.format(p) for f in ("University of {}", "U. of {}", "Universty of {}" if i < 3 else "The University of {}", "Dept. of Law, {} Univ.", "Department of Law, {} University", "{} Institute of Technology", "{} Inst. of Theology", "{} Institute of Theology", "{} Inst. Tech.", "{} Observatory", "{} Obs.", "{} Hospital", "Univ. of {}", "University of {}, Department of Physics")]
    df = spark.createDataFrame([(i, o, "x") for i, o in enumerate(rows)] * 2, "org_id long, org string, id string")
    got = {(r.id_a, r.id_b) for r in names.org_pairs(df).collect()}
    assert {g for g in got if g[1] < n} == {(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (5, 6), (8, 10), (15, 16), (15, 17), (16, 17)}
    assert all((a - n) // 14 == (b - n) // 14 for a, b in got if a >= n) and len([g for g in got if g[0] >= n]) == 30 * (6 + 1 + 1 + 1 + 1)
    assert names.org_pairs(df.where("false")).count() == 0


# ---- distinctive terms


def test_upper_tail_is_exact():
    rng = random.Random(2)
    for _ in range(60):
        total = rng.randint(5, 60)
        n, m = rng.randint(1, total), rng.randint(1, total)
        k = rng.randint(max(1, n + m - total), min(n, m)) if min(n, m) >= max(1, n + m - total) else 1
        p = sum(comb(m, j) * comb(total - m, n - j) for j in range(k, min(n, m) + 1) if n - j <= total - m) / comb(total, n)
        got = distinctive.upper_tail(np.array([k]), np.array([n]), np.array([m]), np.array([total]))[0]
        assert got == pytest.approx(-log(p), abs=1e-7)


def test_terms(spark):
    rows = [("p1", "Alpha alpha beta", None, "Gamma!", 2), ("p1", "older text here", None, "", 1), ("p2", "alpha beta", "beta", "", 1), ("p3", None, "", None, 1), (None, "alpha", "", "", 1), ("p2", "alpha beta", "beta", "", 1)]
    df = spark.createDataFrame(rows, "id string, title string, abstract string, keywords string, updated_at int").selectExpr("*", "1 as term", "2 as df")
    r = {(x.paper_id, x.term): x for x in distinctive.distinctive_terms(df, ["title", "abstract", "keywords"]).collect()}
    assert set(r) == {("p1", "alpha"), ("p1", "beta"), ("p1", "gamma"), ("p2", "alpha"), ("p2", "beta")}
    assert (r["p1", "alpha"].tf, r["p1", "alpha"].df, r["p1", "alpha"].cf, r["p1", "alpha"].n_terms) == (2, 2, 3, 4)
    assert all(0 <= x.score_fdr <= x.score + 1e-12 for x in r.values())
    assert distinctive.distinctive_terms(df.where("false"), ["title"]).count() == 0


# ---- similar sets


def test_similar_sets_equal_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        if i % 3 and rows:
            s = list(rng.choice(rows)[1])
            for _ in range(rng.randint(0, 2)):
                s[rng.randrange(len(s))] = f"t{rng.randrange(400)}"
        else:
            s = [f"t{rng.randrange(400)}" for _ in range(rng.randint(3, 10))]
        rows.append((i, [*s, "Hot"] if i % 3 == 0 else s, None if i % 7 else ["  hot ", None, ""]))
    df = spark.createDataFrame([(*r, "x") for r in rows + rows[:20]], "card_id long, coauthors array<string>, organization array<string>, id string")
    m, c = set_pairs.similar_sets(df, "card_id", ["coauthors", "organization"], node_limit=8)
    got = {(r.card_a, r.card_b) for r in set_pairs.expand_pairs(m, c).collect()}
    sets = {i: {re.sub(r"\s+", " ", x.lower()).strip() for x in [*(a or []), *(b or [])] if x and x.strip()} for i, a, b in rows}
    want = {(i, j) for i, j in combinations(sorted(sets), 2) if min(len(sets[i]), len(sets[j])) >= 4 and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j]) - 1e-9}
    assert got <= want and len(got) >= 0.995 * len(want)


@pytest.mark.parametrize("tuning", [{}, {"node_limit": 4}, {"node_limit": 4, "max_depth": 2}])
def test_similar_sets_of_a_hub_lose_no_pair(spark, tuning):
    rng = random.Random(3)
    sets = {i: {"org", "a", "b", f"x{i}"} for i in range(200)}
    for i in range(200, 320):  # sets of unequal size around one lab
        sets[i] = {f"m{k}" for k in rng.sample(range(14), rng.randint(4, 12))} | {f"y{rng.randrange(40)}" for _ in range(rng.randint(0, 2))}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "card_id long, t array<string>")
    m, c = set_pairs.similar_sets(df, "card_id", ["t"], **tuning)
    want = {(i, j) for i, j in combinations(sorted(sets), 2) if len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j]) - 1e-9}
    assert len(want) > 19900 and {(r.card_a, r.card_b) for r in set_pairs.expand_pairs(m, c).collect()} == want


def test_similar_sets_empty(spark):
    df = spark.createDataFrame([(1, None), (2, []), (None, ["a", "b", "c", "d"])], "card_id long, t array<string>")
    m, c = set_pairs.similar_sets(df, "card_id", ["t"])
    assert m.count() == 0 and c.count() == 0


# ---- broken pairs


def test_classifier_on_held_out_pairs(spark):
    rows = []
    rng = random.Random(4)
    for i in range(160):
        n = rng.randint(2, 6)
        p = f"Group the papers of Ada Byron{i}.\n\n" + "\n\n".join(f"[record_index {k}]\nTitle: Study of topic{rng.randrange(50)} in region{k}\nCoauthors: Person{rng.randrange(99)} Name" for k in range(n))
        if i % 2:
            c = '{"assignments":{' + ",".join(f'"{k}":"{rng.randrange(2)}"' for k in range(n)) + '},"labels":{"0":"graph study","1":"wave model"}}'
            rows.append({"response_id": i, "request_id": i, "content": c, "finish_reason": "stop", "task": "assign", "prompt_lang": "en", "prompt": p, "name": "Ada Byron"})
        else:
            c = " ".join(rng.sample(["The author works mainly on waves and graphs.", "Several coauthors return over the years.", "I am sorry to leave one paper open, but its evidence is thin.", "The title cannot be explained by any other profile."], 2))
            rows.append({"response_id": i, "request_id": i, "content": c, "finish_reason": "stop", "task": "profile", "prompt_lang": "en", "prompt": p, "name": "Ada Byron"})
    model = pairs.train(rows[:120])
    assert min(model["held_out_f1"].values()) > 0.9
    assert sum(pairs.classify(model, r) is None for r in rows[120:]) >= 39
    a = rows[121]
    change = lambda **k: pairs.classify(model, a | k)
    assert change(content=None) == "empty" and change(content='{"assignments":{},"labels":{}}') == "empty"
    assert change(content=a["content"][:20], finish_reason="length") == "truncated"
    assert change(content="I regret that I am not in a position to do this; my rules forbid it, so I will not answer.") == "refusal"
    assert change(content="Sure:\n" + a["prompt"]) == "copied"
    assert pairs.classify(model, rows[120] | {"content": "Die Person arbeitet vor allem zu Graphen und Wellen. Einträge ohne Adresse passen zu derselben Richtung."}) == "other_language"
    assert pairs.train([])["held_out_f1"] is None
    # the n-grams carry the decision on refusals and languages: without them hardly any is found
    unseen = ["No. I keep away from judging other people's work.", "Sadly, it isn't something I could ever agree to.", "My instructions forbid this, hence nothing follows here.", "Apologies; you will not get an answer from me.", "This exceeds what I am willing to do today."]
    foreign = ["La persona trabaja sobre todo en ondas y desde entonces vuelve a los grafos.", "Questa persona lavora da anni sulle onde e anche sui grafi.", "Cet auteur travaille depuis longtemps sur les ondes et les graphes."]
    bare = pairs.without_ngrams(model)
    full = [pairs.classify(model, rows[i] | {"content": t}) for i in (120, 122) for t in unseen]
    assert full.count("refusal") >= 8 and [pairs.classify(bare, rows[i] | {"content": t}) for i in (120, 122) for t in unseen].count("refusal") <= 2
    assert [pairs.classify(model, rows[120] | {"content": t}) for t in foreign].count("other_language") >= 2
    assert [pairs.classify(bare, rows[120] | {"content": t}) for t in foreign].count("other_language") == 0


def test_repeated_requests_and_null_ids(spark):
    p = "Group the papers of Ada.\n\n[record_index 0]\nTitle: waves\n\n[record_index 1]\nTitle: graphs"
    good = '{"assignments":{"0":"0","1":"1"},"labels":{"0":"waves","1":"graphs"}}'
    req = spark.createDataFrame([(i, "assign", "en", p, "Ada", k, "x") for i in range(40) for k in (1, 1, 2)], "request_id long, task string, prompt_lang string, prompt string, name string, created_at int, content string")
    res = [(i, i, good, "stop", {"0": "0", "1": "1"}) for i in range(40)] + [(50, None, None, None, None), (50, None, None, None, None), (51, 3, "", "stop", None), (52, 4, good[:30], "length", None), (None, 1, "", None, None), (53, 99, "", None, None)]
    got = pairs.broken_pairs(spark.createDataFrame(res, "response_id long, request_id long, content string, finish_reason string, assignments map<string,string>"), req)
    assert {tuple(r) for r in got.collect()} == {(50, "empty"), (51, "empty"), (52, "truncated"), (53, "empty")}


def test_parsed_map_is_read_where_content_does_not_parse():
    p = "Group the papers.\n\n" + "\n\n".join(f"[record_index {k}]\nTitle: t" for k in range(3))
    c = '{"assignments":{"0":"0","1":"0","2":"1"},"labels":{"0":"graph study"}}'
    read = lambda content, keys: pairs.Pair(p, "en", "assign", content, None, keys).x
    for content in ("The set {0, 1} is one author.\n" + c, c.replace('}}', '},}')):
        x = read(content, ["0", "1", "2"])
        assert x[5] and not x[7] and not x[8]
        assert read(content, ["0", "1", "2"] if content.endswith(c) else ["0", "1"])[7] == (not content.endswith(c))
        assert read(content, None)[8]
    assert read(c[:30], ["0", "1", "2"])[8]


def test_broken_pairs_table(spark, data):
    from blockwise.common import read_table

    res, req = read_table(spark, data, "cluster_responses"), read_table(spark, data, "cluster_requests")
    assert pairs.broken_pairs(res.where("false"), req).count() == 0
    got = pairs.broken_pairs(res.selectExpr("*", "1 as prompt"), req.where("false")).collect()
    assert got == []


# ---- consistent form


@pytest.mark.parametrize("value, form", [
    ("Ｏｘ　Ｌａｂ", "Ox Lab"), ("Petra Solen", "Petra Solen"), ("Pe​tra­", "Petra"), ("Zoë", "Zoë"), ("Pеtrа", "Petra"), ("Ζ. Gogel", "Z. Gogel"), ("𝖾dge", "edge"), ("ﬁrn", "firn"), ("A‑B", "A-B"),
    ("Школа", "Школа"), ("Law (Физика)", "Law (Физика)"), ("Оскар", "Оскар"), ("Zoë  two ", "Zoë  two "), ("石‌泉", "石泉"), ("", ""), (None, None), ("É", "É"), ("it's a 'q'", "it's a 'q'"),
])
def test_form(spark, value, form):
    df = spark.createDataFrame([(1, value, "taken")], "id int, v string, v_form string")
    out = consistent.consistent_form(df, ["v"])
    assert out.columns == ["id", "v", "v_form", "_v_form"] and out.first()["_v_form"] == form


def test_disguised(spark):
    df = spark.createDataFrame([(1, "Pеtra", "x"), (1, "Pеtra", "x"), (2, None, "Ｏx"), (None, "Ｏx", None)], "entry_id long, name string, org string")
    assert {tuple(r) for r in consistent.disguised(df, "entry_id", ["name", "org"]).collect()} == {(1, "name"), (2, "org")}
    assert consistent.disguised(df.where("false"), "entry_id", ["name"]).count() == 0


# ---- packing


def test_pack_sizes_places_every_item_once():
    rng = random.Random(6)
    for cap in (10, 64, 2048):
        hist: dict[int, int] = {}
        for _ in range(800):
            s = rng.choice([rng.randint(1, cap), rng.randint(1, max(1, cap // 5))])
            hist[s] = hist.get(s, 0) + 1
        slots, made = packing.pack_sizes(hist, cap)
        fill, seen = [0] * made, {s: [] for s in hist}
        big = [0] * made
        for s, first, n, c in slots:
            seen[s] += range(first, first + n)
            for k in range(n):
                fill[c + k] += s
                big[c + k] += 3 * s > cap
        assert all(sorted(v) == list(range(hist[s])) for s, v in seen.items())
        assert max(fill) <= cap and max(big) <= 2
        assert made <= -(-sum(s * n for s, n in hist.items()) // cap) * 1.08 + 1
    assert packing.pack_sizes({}, 10) == ([], 0)
    with pytest.raises(ValueError):
        packing.pack_sizes({11: 1}, 10)


def test_fill_containers(spark):
    texts = [(i, ("word " * (i % 90 + 1)).strip()) for i in range(120)] + [(200, "long " * 500), (201, ""), (202, None), (0, "word"), (203, "字" * 600)]
    df = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, rank int")
    got = packing.fill_containers(df, 128).collect()
    fill: dict[int, int] = {}
    for r in got:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert max(fill.values()) <= 128 and {r.doc_id for r in got} == {i for i, t in texts if t}
    assert len({(r.doc_id, r.piece_no) for r in got}) == len(got) and {r.doc_id for r in got if r.piece_no} == {200, 203}
    enc = packing.load_tokenizer(packing.TOKENIZER)
    tokens = enc.encode_ordinary("字" * 600)
    parts = [enc.decode(tokens[s:e]) for s, e in packing.cut_tokens(enc, "字" * 600, 128)]
    assert "".join(parts) == "字" * 600 and not any("�" in p for p in parts)
    assert packing.fill_containers(df.where("false"), 128).count() == 0


# ---- leakage


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(20):
        a = np.array([rng.randrange(4) for _ in range(rng.randint(0, 40))])
        assert list(leakage.suffix_array(a)) == sorted(range(len(a)), key=lambda i: list(a[i:]))


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 14, 25])))) for i in range(12)]
    docs = []
    for d in range(60):
        words = [rng.choice(vocab + ["other"]) for _ in range(rng.randint(0, 60))]
        if d % 3 == 0:
            w = rng.choice(items)[1].split()
            s = rng.randrange(len(w))
            words[len(words) // 2 : 0] = w[s : s + rng.randint(8, 20)]
        docs.append((d, "".join(w.upper() + rng.choice([" ", "\n", ", ", "* "]) for w in words)))
    docs += [(100, None), (101, ""), (docs[0][0], docs[0][1])]
    monkeypatch.setattr(leakage, "SHARD_WORDS", 200)
    monkeypatch.setattr(leakage, "ITEMS_PER_PASS", 5)
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    t = spark.createDataFrame(items + [(50, None)], "item_id long, passage string")
    hits = leakage.leaked_passages(d, t)
    grams = lambda s, n: {tuple(w[i : i + n]) for w in [re.findall("[a-z0-9]+", (s or "").lower())] for i in range(len(w) - n + 1)}
    want = {(i, k) for i, x in docs for k, p in items if grams(x, 12) & grams(p, 12)}
    assert {(r.doc_id, r.item_id) for r in hits.collect()} == want
    text = dict(docs)
    for r in hits.collect():
        w, p = re.findall("[a-z0-9]+", text[r.doc_id].lower()), dict(items)[r.item_id].split()
        assert w[r.doc_word : r.doc_word + r.n_words] == p[r.item_word : r.item_word + r.n_words]
    assert {r.doc_id for r in leakage.decontaminate(d, hits).collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert leakage.leaked_passages(d.where("false"), t).count() == 0 and leakage.leaked_passages(d, t.where("false")).count() == 0


# ---- quality


@pytest.mark.parametrize("text, kind", [
    ("The reviewers liked the study, but they doubted the data. It was checked by hand.", "prose"), ("die arbeiten über boden gehören zu einer person. es bleibt offen, ob das so ist.", "prose"),
    ("One line of prose that is wrapped\nin the middle of a sentence and\nends here.", "prose"), ("Ada Byron\nBo Derek\nCy Young", "list"), ("- a b\n- c d\n* e f", "list"), ("a,b,c,d,e\n1,2,3,4,5\n6,7,8,9,N/A", "table"),
    ("| a | b | c |\n| --- | --- | --- |\n| 1 | 2 | 3 |", "table"), ("lorem " * 40, "junk"), ("x" * 300, "junk"), ("&lt;div&gt;&nbsp;&lt;/div&gt;\n" * 4, "junk"),
])
def test_kind_of_text(text, kind):
    s = quality.document_statistics(text)
    shares = dict(zip(quality.KINDS, s[-4:]))
    assert max(shares, key=shares.get) == kind


def test_report(spark):
    rows = [(i, "The reviewers liked the study, but they doubted the data of it.", "en") for i in range(20)] + [(50, None, None), (51, "", " "), (52, "Ada Byron\nBo Derek\nCy Young\nDi Moss", "EN"), (52, "Ada Byron\nBo Derek\nCy Young\nDi Moss", "EN"), (None, "x", "en")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    r = {x.doc_id: x for x in quality.quality_report(df).collect()}
    assert len(r) == 23 and r[52].kind == "list" and r[50].kind == r[51].kind == "empty" and r[0].kind == "prose" and r[50].lang == "und"
    assert quality.quality_report(df.where("false")).count() == 0


def test_kind_in_a_language_of_lists_and_in_rare_languages(spark):
    table, junk, names_ = "a,b,c,d,e\n1,2,3,4,5\n6,7,8,9,N/A", "lorem " * 40, "Ada Byron\nBo Derek\nCy Young\nDi Moss"
    prose = "die arbeiten über boden gehören zu einer person. es bleibt offen, ob das so ist."
    rows = [(i, names_, "de") for i in range(12)] + [(i, prose, "de") for i in range(12, 20)] + [(20, table, "xx"), (21, junk, "yy"), (22, names_, "zz"), (23, junk, "zz"), (24, prose, "ww")]
    rows += [(i, f"The reviewers liked study {i}, but they doubted the data of it.", "en") for i in range(30, 50)]
    r = {x.doc_id: x.kind for x in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {r[i] for i in range(12)} == {"list"} and {r[i] for i in [*range(12, 20), *range(30, 50)]} == {"prose"}
    assert (r[20], r[21], r[22], r[23], r[24]) == ("table", "junk", "list", "junk", "prose")


def test_tails_are_exact(spark):
    vals = [0.1, 0.2, 0.2, 0.2, 0.5, 0.9]
    df = spark.createDataFrame([(i, "en", v) for i, v in enumerate(vals)] + [(9, "de", 7.0), (10, "de", None)], "doc_id long, lang string, x double")
    long, table = quality.rank_tails(df, ["x"])
    assert long.count() == 7
    got = {(r.lang, r.value): (r.low, r.high, r.low_all, r.high_all) for r in table.collect()}
    every = [*vals, 7.0]
    for lang, own in (("en", vals), ("de", [7.0])):
        for v in own:
            want = [sum(u <= v for u in own) / len(own), sum(u >= v for u in own) / len(own), sum(u <= v for u in every) / 7, sum(u >= v for u in every) / 7]
            assert got[lang, v] == pytest.approx(want)


def test_scores_part_prose_from_the_rest(spark):
    """The outlier score alone, without the check of the lines, tells nearly all documents apart."""
    rng = random.Random(12)
    common = "the of and to in a is that for it as was with be by on not they which one".split()
    rows, kinds = [], []
    for i in range(600):
        word = lambda: "".join(rng.choice("bcdfglmnprstaeiou") for _ in range(rng.randint(3, 8)))
        if i % 12 == 0:
            text = "\n".join(f"- {word().capitalize()} {word().capitalize()}" for _ in range(rng.randint(5, 20)))
        elif i % 12 == 1:
            text = "\n".join(",".join(str(rng.randrange(1000)) for _ in range(5)) for _ in range(rng.randint(5, 20)))
        elif i % 12 == 2:
            text = rng.choice([(word() + " ") * 60, "".join(rng.choice("#@%&*~^") for _ in range(200)), "&nbsp;<br/></div>" * 20])
        else:
            text = " ".join((" ".join(rng.choice(common) if rng.random() < 0.4 else word() for _ in range(rng.randint(6, 15))) + ".").capitalize() for _ in range(rng.randint(2, 9)))
            if i % 5 == 0:
                text = text.lower().replace(" the ", "\n")
        rows.append((i, text, "de" if i % 7 == 0 else "en"))
        kinds.append(i % 12 > 2)
    r = {x.doc_id: x for x in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    good = [r[i].score for i in r if kinds[i]]
    bad = [r[i].score for i in r if not kinds[i]]
    assert sum(b > g for b in bad for g in good) >= 0.99 * len(bad) * len(good)
    assert all((r[i].kind == "prose") == kinds[i] for i in r)
    # a group of copies of a third of all rows neither hides itself nor changes the others
    rows += [(1000 + i, "lorem " * 60, "en") for i in range(300)]
    again = {x.doc_id: x.kind for x in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(again[i] == r[i].kind for i in r) and {again[1000 + i] for i in range(300)} == {"junk"}


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(sys.modules["blockwise"].__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "blockwise.llm" not in f.read_text()
