import random
import re

import pytest

from tidemark.llm import conversations, lookalikes, mixing, packing, personal, residue, splitting, tokens


# --- splitting -------------------------------------------------------------------------------------------------------
def texts(rng):
    words = ["alpha", "be", "gamma-delta", "ž", "終わり。", "end.", "\n", "\n\n", "\n## head\n", "x" * 90, "é\u0301", " "]
    return "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 300)))


@pytest.mark.parametrize("limit,overlap", [(50, 10), (20, 0), (2000, 200), (5, 4)])
def test_pieces_cover_overlap_and_fit(limit, overlap):
    rng = random.Random(limit)
    for _ in range(60):
        t = texts(rng)
        s = splitting.spans(t, limit, overlap)
        assert s[0][0] == 0 and s[-1][1] == len(t)
        assert all(0 < b - a <= limit for a, b in s) or t == ""
        assert all(c == b - min(overlap, b) for (_, b), (c, _) in zip(s, s[1:]))
        assert (len(s) > 1) == (len(t) > limit)


def test_cuts_fall_on_the_most_natural_boundary():
    t = "one two. " * 3 + "\n\n" + "three four. " * 3
    assert [t[a:b] for a, b in splitting.spans(t, 40, 0)] == ["one two. " * 3 + "\n\n", "three four. " * 3]
    assert splitting.spans("ab cd ef", 5, 0) == [(0, 3), (3, 8)]


def test_split_rows(spark):
    df = spark.createDataFrame([(1, "a" * 30, 7), (2, None, 7), (3, "", 7), (4, "b" * 10, 7), (4, "b" * 10, 7)], "row_id long, text string, piece int")
    got = sorted((r.row_id, r.piece_no, r.piece) for r in splitting.split_oversized(df, 10, 2).collect())
    assert [g for g in got if g[0] > 1] == [(3, 1, ""), (4, 1, "b" * 10), (4, 1, "b" * 10)]
    assert "".join(p if n == 1 else p[2:] for r, n, p in got if r == 1) == "a" * 30
    assert splitting.split_oversized(df.limit(0), 10, 2).count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(df, 10, 10)


def test_very_long_text_is_cut_in_linear_time():
    assert len(splitting.spans("word " * 400_000, 2000, 200)) == 1 + -(-(2_000_000 - 2000) // 1800)
    assert len(splitting.spans("x" * 1_000_000, 2000, 200)) == 1 + -(-(1_000_000 - 2000) // 1800)


# --- personal data ---------------------------------------------------------------------------------------------------
PARTS = [("Mirvana", "given"), ("Tobrek", "given"), ("Toldekar", "family"), ("Vexley-Thorn", "family"), (None, "family")]


def found(spark, rows, **names):
    df = spark.createDataFrame(rows, "row_id long, text string, input string, kind string")
    parts = spark.createDataFrame(PARTS, "name_part string, part_kind string")
    return {(r.row_id, r.field, r.kind, r.found) for r in personal.personal_stretches(df, parts).collect()}, df, parts


def test_stretches_and_what_only_looks_like_them(spark):
    rows = [
        (1, "Mail a.b+c@mail.example.com, or mirvana (at) posta (dot) example. Not deploy@build-node, parser@2.4.13, @orchard/fold@6.0.1", None, ""),
        (2, "Call +44 20 7946 0377 or (303) 555 0117, 07700\xa0900\xa0869; not 127.0.0.1:9081, 1 024 759 px, 2022-10-26 10:25:55.803", None, ""),
        (3, "QQ 68 73 16 B, XZ9229031, EX 180700, 734821 / 4832, 970-42-9878. Build 2024/0349, MX-225-2, 20637-12-209", None, ""),
        (4, "Ship to 74A Ostrelby Road, 33-421 Ostrel or ul. Pod Skalkovcom 143/9; Torfnerallee 13a, Na Výhonku ulica 152. 87 rows, Street view was off", None, ""),
        (5, "Ing. TOLDEKAR Mirvana and Vexley-Thorn, Tobrek; M. Toldekar; Mirvana A. Toldekar. Code Map, Mirvana alone", None, ""),
        (6, None, '{"a": "\\u0054oldekar, Mirvana", "b": ["x@y.example"]}', ""),
        (7, "", '"{\\"q\\": \\"call 415-555-0156\\"}"', ""),
        (8, "x@y.example x@y.example", "cut off {x@y.example", ""),
        (9, "", None, None),
    ]
    got, _, _ = found(spark, rows)
    assert got == {
        (1, "text", "email", "a.b+c@mail.example.com"), (1, "text", "email", "mirvana (at) posta (dot) example"),
        (2, "text", "phone", "+44 20 7946 0377"), (2, "text", "phone", "(303) 555 0117"), (2, "text", "phone", "07700\xa0900\xa0869"),
        *((3, "text", "id_number", x) for x in ("QQ 68 73 16 B", "XZ9229031", "EX 180700", "734821 / 4832", "970-42-9878")),
        *((4, "text", "address", x) for x in ("74A Ostrelby Road", "ul. Pod Skalkovcom 143/9", "Torfnerallee 13a", "Na Výhonku ulica 152")),
        *((5, "text", "name", x) for x in ("TOLDEKAR Mirvana", "Vexley-Thorn, Tobrek", "M. Toldekar", "Mirvana A. Toldekar")),
        (6, "input", "name", "Toldekar, Mirvana"), (6, "input", "email", "x@y.example"), (7, "input", "phone", "415-555-0156"),
        (8, "text", "email", "x@y.example"), (8, "input", "email", "x@y.example"),
    }


def test_forms_off_the_beaten_track_and_numbers_that_only_look_like_papers(spark):
    rows = [(1, "At 221B Baker Parkway, 12345 Main Street, 500 Elm Plaza and Rue de Rivoli 12", None, ""), (2, "Call 555-0123 today", None, ""), (3, "See PR 123456 and GH 1234567", None, ""), (4, "In PR 123457", None, "")]
    rows += [(5, "passport XZ9229031", None, ""), (6, "then XZ9229032 came", None, "")]
    got, _, _ = found(spark, rows)
    assert {x[3] for x in got} == {"221B Baker Parkway", "12345 Main Street", "500 Elm Plaza", "Rue de Rivoli 12", "555-0123", "XZ9229031", "XZ9229032"}


def test_unlisted_names_are_learned_from_what_they_stand_beside(spark):
    rows = [(i, f"Assigned to Ludeka {f} until then.", None, "") for i, f in enumerate(["Toldekar", "Vexley-Thorn"])]
    rows += [(10 + i, f"By {g} Corvanet now.", None, "") for i, g in enumerate(["Mirvana", "Tobrek"])]
    rows += [(20, "Then Ludeka Corvanet came. Der Lauf Toldekar", None, "")] + [(30 + i, "Lauf und Lauf. By hand.", None, "") for i in range(9)]
    got, _, _ = found(spark, rows)
    assert {x[3] for x in got} == {"Ludeka Toldekar", "Ludeka Vexley-Thorn", "Mirvana Corvanet", "Tobrek Corvanet", "Ludeka Corvanet"}


def test_placeholders_leave_the_rest_alone(spark):
    import json

    rows = [(1, "Hi Mirvana Toldekar, write to a@b.example!", json.dumps({"n": "Mirvana Toldekar", "e": ["é a@b.example"]}), "k"), (2, "nothing", None, "k"), (3, None, None, "k")]
    _, df, parts = found(spark, rows)
    out = {r.row_id: r for r in personal.sanitise(df, parts).collect()}
    assert out[1].text == "Hi [name], write to [email]!" and json.loads(out[1].input) == {"n": "[name]", "e": ["é [email]"]}
    assert (out[2].text, out[2].input, out[3].text, out[3].kind) == ("nothing", None, None, "k")
    assert personal.personal_stretches(df.limit(0), parts).count() == 0


# --- conversations ---------------------------------------------------------------------------------------------------
def message(row_id, session, line, kind, text, uuid=None, parent=None, role=None, usage=None):
    return (row_id, session, line, kind, uuid, parent, role, text, (usage,) if usage is not None else None, "x")


MESSAGE = "row_id long, session string, line_no long, type string, uuid string, parent_uuid string, role string, text string, usage struct<output_tokens:long>, speaker string"


def test_sessions_to_drop_and_turns_that_stay(spark):
    u = [f"{i:032x}" for i in range(1, 30)]
    rows = [
        message(1, "good", 1, "user", "hi", u[0]), message(2, "good", 2, "assistant", "yo", u[1], u[0].upper(), "Model"),
        message(3, "good", 9, "assistant", "yo!", u[1], u[0], "model", 5), message(4, "good", 3, "user", "\u200b \n", u[2]), message(5, "good", 4, "system", "sys", u[3]),
        message(6, "empty", 1, "system", "s"), message(7, "first", 1, "assistant", "a"), message(8, "open", 1, "user", "a"), message(9, "open", 2, "assistant", "b"), message(10, "open", 3, "user", "c"),
        message(11, "two", 1, "user", "a"), message(12, "two", 2, "user", "b"), message(13, "two", 5000, "assistant", "c"), message(14, "orphan", 1, "user", "a", u[4], u[5]), message(15, "orphan", 2, "assistant", "b"),
        message(16, "far", 1, "user", "a"), message(17, "far", 5001, "user", "b"), message(18, "far", 9001, "assistant", "c"),
        message(19, "roles", 1, "assistant", "a", role=" HUMAN "), message(20, "roles", 2, "user", "b", role="assistant"), message(21, None, 1, "user", "x"), message(22, "nolines", None, "user", "a"), message(23, "nolines", None, "assistant", "b"),
    ]
    df = spark.createDataFrame(rows, MESSAGE)
    assert {r.session for r in conversations.dropped_sessions(df).collect()} == {"empty", "first", "open", "two", "orphan", "far"}
    kept = sorted((r.session, r.turn_no, r.speaker, r.row_id, r.text) for r in conversations.conversations(df).collect())
    assert kept == [("good", 1, "user", 1, "hi"), ("good", 2, "assistant", 3, "yo!"), ("nolines", 1, "user", 22, "a"), ("nolines", 2, "assistant", 23, "b"), ("roles", 1, "user", 19, "a"), ("roles", 2, "assistant", 20, "b")]
    assert conversations.dropped_sessions(df.limit(0)).count() == 0


# --- look-alikes -----------------------------------------------------------------------------------------------------
def test_what_looks_the_same_and_what_does_not():
    same = ["Cafe\u0301 file", "Café ﬁle", "Ｃafé\u00a0file", "C\u200bafé \u00adfile", "Саfé filе"]
    assert len({lookalikes.skeleton(t) for t in same}) == 1
    other = ["café file", "Cafe file", "Café fi1e", "Café file2", "Café  file", "Café\nfile", "👩\u200d💻", "👩💻", "x²", "x2"]
    assert len({lookalikes.skeleton(t) for t in [same[0], *other]}) == len(other) + 1
    assert not lookalikes.shows_something("\u200b \u2800") and lookalikes.shows_something("a")


def test_pairs_are_those_of_the_skeletons(spark):
    rng = random.Random(4)
    base = ["the cache reader", "a cat sat on paper", "перевір кеш а потім", "see c00x1a1", "ο λόγος", "app core", "x y", "Ref 0x1c0"]
    swap = {a: c for a, c in (p for p in lookalikes.LATIN_CYRILLIC.split())} | {c: a for a, c in (p for p in lookalikes.LATIN_CYRILLIC.split())}
    rows = [(i, t, "k") for i, t in enumerate(base)]
    for _ in range(60):
        t = rng.choice(base)
        rows.append((len(rows), "".join(swap[c] if c in swap and rng.random() < 0.4 else c for c in t).replace(" ", rng.choice([" ", "\u2009", "\u00a0"])), "k"))
    rows += [(900, None, ""), (901, "", ""), (902, "\u200b", ""), (903, " ", ""), (904, "the cache reader", "")]
    df = spark.createDataFrame(rows, "row_id long, text string, key string")
    got = {tuple(r) for r in lookalikes.same_look_pairs(df).collect()}
    shown = [(i, t) for i, t, _ in rows if t and lookalikes.shows_something(t)]
    want = {(a, b) for a, s in shown for b, t in shown if a < b and s != t and lookalikes.skeleton(s) == lookalikes.skeleton(t)}
    assert got == want and len(want) > 100
    one = {r.row_id: r.text_unified for r in lookalikes.unify(df, row_col="row_id").collect()}
    assert one[900] is None and all(one[a] == one[b] for a, b in want)


def test_many_equal_texts_cost_only_their_pairs(spark):
    df = spark.range(60_000).selectExpr("id AS row_id", "'the cache reader' AS text").union(spark.createDataFrame([(70_000, "the\u00a0cache reader"), (70_001, "the\u2009cache reader")], "row_id long, text string"))
    pairs = lookalikes.same_look_pairs(df)
    assert pairs.count() == 2 * 60_000 + 1 and pairs.where("row_id_2 < 70000").count() == 0


# --- packing ---------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(6))
def test_containers_hold_all_and_are_few(seed):
    rng = random.Random(seed)
    sizes = [min(100, max(1, int(rng.expovariate(1 / 25)))) for _ in range(600)]
    containers, fixed = packing.reduce_and_fill(sizes, 100)
    assert sorted(s for c in containers for s in c) == sorted(sizes) and all(sum(c) <= 100 for c in containers)
    assert len(containers) <= -(-sum(sizes) // 100) + 2 and fixed > 0


def test_the_reduction_keeps_the_optimum():
    def optimum(sizes, cap):
        best = [len(sizes)]

        def go(left, rooms):
            if len(rooms) >= best[0]:
                return
            if not left:
                best[0] = len(rooms)
                return
            for i in {r: i for i, r in enumerate(rooms) if r >= left[0]}.values():
                go(left[1:], [*rooms[:i], rooms[i] - left[0], *rooms[i + 1 :]])
            go(left[1:], [*rooms, cap - left[0]])

        go(sorted(sizes, reverse=True), [])
        return best[0]

    rng = random.Random(9)
    for _ in range(200):
        sizes = [rng.randrange(1, 31) for _ in range(rng.randrange(1, 9))]
        containers, fixed = packing.reduce_and_fill(sizes, 30)
        rest = [s for c in containers[fixed:] for s in c]
        assert fixed + optimum(rest, 30) == optimum(sizes, 30)


def test_pack_rows(spark):
    df = spark.createDataFrame([(1, 250, "a"), (2, 60, "a"), (3, 40, "a"), (4, 0, "a"), (5, None, "a"), (6, 100, "a"), (7, 200, "a"), (8, 50, "a"), (8, 50, "a")], "doc_id long, tokens long, container string")
    placed = packing.pack_sizes(df, 100).collect()
    by = {}
    for r in placed:
        by.setdefault(r.container, []).append(r.size)
    assert all(sum(v) <= 100 for v in by.values()) and sum(map(sum, by.values())) == 750
    assert len(by) == 8 and {r.doc_id for r in placed if r.n_parts > 1} == {1, 7} and {r.doc_id for r in placed} == {1, 2, 3, 6, 7, 8}
    assert packing.pack_sizes(df.limit(0), 100).count() == 0


# --- mixing ----------------------------------------------------------------------------------------------------------
def test_capped_poisson_has_the_wanted_mean():
    for rate in (0.0, 0.05, 0.7, 1.9, 3.5):
        assert abs(4 - sum(mixing.capped_cumulative(rate, 4)) - rate) < 1e-6
    assert mixing.capped_cumulative(9, 2) == [0.0, 0.0] and mixing.capped_cumulative(1, 0) == []


def test_shares_are_reached_unless_the_cap_forbids(spark):
    docs = [(i, " A " if i % 2 else "a", 10) for i in range(4000)] + [(10_000 + i, "b", 10) for i in range(2000)] + [(20_000 + i, "c", 10) for i in range(100)] + [(30_000, None, 10), (30_001, "other", 10), (None, "b", 10)]
    sizes = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.3, 2), ("B", 0.5, 3), ("c", 0.15, 4), ("none", 0.05, 9)], "source string, target_share double, max_repeats int")
    plan = mixing.mixing_plan(sizes, targets)
    assert {r.source for r in plan.where("NOT reachable").collect()} == {"c", "none"}
    mixed = mixing.replicate(sizes, plan)
    report = {r.source: r for r in mixing.share_report(mixed, plan).collect()}
    assert abs(report["a"].share_of_total - 0.3) < 0.02 and abs(report["B"].share_of_total - 0.5) < 0.03
    assert report["c"].copies == 400 and report["c"].most_repeats == 4 and report["none"].copies == 0
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.replicate(sizes, plan).collect()))
    assert mixing.mixing_plan(sizes.limit(0), targets).where("NOT reachable").count() == 0


def test_token_counts(spark):
    pytest.importorskip("tiktoken")
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("<|endoftext|>",)], "t string")
    got = [r[0] for r in df.select(tokens.token_count(df.t, "/opt/tokenizers/byte_bpe_50k.tiktoken")).collect()]
    assert got[:3] == [2, 0, 0] and got[3] > 1
    assert tokens.count_tokens("a b " * 60_000) == 120_000 or tokens.count_tokens("a b " * 60_000) > 100_000


# --- residue ---------------------------------------------------------------------------------------------------------
def test_placeholders_outside_of_code_and_quotation():
    yes = ["Hi {{ name }},", "${USER} left", "<%= title %>", "by %(name)s", "at #{date}", "[[title]] is", "<<owner>>", "%OWNER% said", "__TITLE__", "[INSERT EMAIL HERE]", "{% if x %}", "@@name@@", "by {path}.", "· [Next Step]", "---\nproject: {{ p }}\n---\nText."]
    no = ["Write `{{ name }}` there", 'It says "${USER}"', "```\n{{ x }}\n```", "[image] and [redacted:env]", "[label](x.md#L3)", "    {{ code }}", "> {{ quoted }}", "100% SURE 50%", "a[[0]]", "snake__case__name", "see [Label]\n\n[Label]: http://x.example", "[Label][1]", "f(x){return}", ""]
    assert [t for t in yes if not residue.unfilled(t)] == [] and [t for t in no if residue.unfilled(t)] == []


def test_documents_with_residue(spark):
    rows = [
        (1, "# Cache\n\n404 Not Found · heron-cli\n\nThe link may be old or mistyped.", "p1"), (2, "heron-cli | queue\nHome  Docs  Search\n\nSession expired\n\nLog in to keep reading.\n\nPrivacy  Terms", "p1"),
        (3, "This page requires JavaScript.", None), (4, "Lorem ipsum dolor sit amet elit.\n\nNunc nulla dolor sit amet magna.", "p2"), (5, "Trail\n\nYour text goes here. Your text goes here.", "p2"),
        (6, 'Why does load() return "Access denied" for src/a.js when the cache is there?', "p1"), (7, "The fetch step got a 404 Not Found for src/a.js, so the loader now retries.\n\nWe agreed on the limit of the cache.", "p1"),
        (8, "Plain words about a queue.", "p3"), (9, None, "p1"), (10, "", "p1"), (11, "Hello {{ name }}", "p9"), (11, "Hello {{ name }}", "p9"),
    ]
    rows += [(100 + i, f"Server error\n\nOops, odd thing\n\nThat did not work. {i}", f"h{i % 3}") for i in range(6)] + [(200 + i, "Oops, odd thing", f"h{i}") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, project string")
    got = sorted(r.doc_id for r in residue.residue_documents(df).collect())
    assert [x for x in got if x < 100] == [1, 2, 3, 4, 5, 11]
    assert residue.residue_documents(df.limit(0)).count() == 0
    assert {r.doc_id for r in residue.without_residue(df).where("doc_id < 100").collect()} == {6, 7, 8, 9, 10}


def test_pages_of_any_length_go_and_real_sentences_stay(spark):
    codes = "404 not found|403 forbidden|500 internal server error|502 bad gateway|503 service unavailable|504 gateway timeout|401 unauthorized|429 too many requests".split("|")
    page = "\n\n".join(f"Error {c}. The page you asked for does not exist, reference {i}. Please sign in and try again later." for i, c in enumerate(codes * 3))
    long = "The page you were looking for does not exist, " + "the link was mistyped, the page was moved, " * 20 + "."
    rows = [(1, page, "a"), (2, "Maintenance of the cache index runs nightly.", "a"), (3, "The migration moved the file to src/io and the link no longer breaks.", "b"), (4, "Forbidden characters in the branch name", "c"), (5, long, None)]
    got = {r.doc_id for r in residue.residue_documents(spark.createDataFrame(rows, "doc_id long, text string, project string")).collect()}
    assert got == {1, 5}


def test_the_corpus_decides_on_statements_and_words_without_form(spark):
    mash = ["wub", "zog", "plim", "dax", "vorp"]
    rng = random.Random(3)
    rows = [(i, f"# Cache tracker\n\nThe kettle is cold, dear visitor.\n\nCome another day {i}.", f"h{i % 4}") for i in range(12)]
    rows += [(100 + i, " ".join(rng.choice(mash) for _ in range(14)), f"h{i % 4}") for i in range(12)]
    rows += [(200 + i, f"The reader keeps one cache. load_{i}() returns {i} rows.", f"h{i % 4}") for i in range(12)] + [(300, "The reader keeps one cache.", "h1")]
    got = {r.doc_id for r in residue.residue_documents(spark.createDataFrame(rows, "doc_id long, text string, project string")).collect()}
    assert got == {r[0] for r in rows if r[0] < 200}


def test_very_long_documents_are_quick():
    for t in ("{" * 50_000, "a" * 200_000, "word " * 60_000, "[" * 50_000 + "(" * 1000, '"' * 50_001, "`" * 3001):
        residue.unfilled(t)
        residue.dissect(t)
    assert re.search(residue.PLACEHOLDERS, "{{x}}")
