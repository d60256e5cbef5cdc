"""HTML extraction, vector codes and conversation repair: brute force, by definition, and the awkward inputs."""

import hashlib
import html
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside.llm import byteconv, convrepair, decontam, htmltext, linedup, queries, vectorcode

SF = "/root/testdata/sf0.001"
PROSE = "It is said that the people of the town have been there for a long time and that they know all of it, and so we went with them to see what they do in the morning. "


def text_of(page):
    return " ".join(b.text for b in htmltext.labelled(page, htmltext.stop_set()) if b.label == htmltext.GOOD)


def article_only(page):
    """The text between the article's tags by plain means, for pages whose article holds nothing else."""
    own = page[page.index("<article>") + 9 : page.index("</article>")]
    own = re.sub(r"<(?!/?b>)[^>]*>", " ", own)
    return " ".join(html.unescape(re.sub("</?b>", "", own)).split())


def test_pages_hold_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: article_only(r.html) for r in pages.collect()}
    got = queries.op11_html_blocks(spark, SF).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_articles_are_found_without_their_tags(spark):
    """The same pages with every structural tag made a division: the block rules have to tell."""
    equal = total = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        bare = re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", r.html).replace(' class="ad"', "")
        total += 1
        equal += text_of(bare) == article_only(r.html)
    assert equal / total > 0.97, (equal, total)


@pytest.mark.parametrize(
    "around",
    [
        '<nav><ul><li><a href="/a">All of the news that is in</a></li></ul></nav>{}',
        "<header><p>" + PROSE + "</p></header>{}<footer><p>" + PROSE + "</p></footer>",
        '{}<aside><h2>More</h2><p>' + PROSE + "</p></aside>",
        '<div class="cookie-banner" role="dialog"><p>' + PROSE + "</p><button>OK</button></div>{}",
        '{}<form action="/s"><label>Your name</label><p>' + PROSE + '</p><input value="x"></form>',
        '{}<section id="comments"><article class="comment"><p>' + PROSE + "</p></article></section>",
        '{}<div class="adBox ad">' + PROSE + "</div><script>if (a < b) document.write('</p><p>" + PROSE + "')</script>",
        "<!-- <p>" + PROSE + "</p> -->{}<style>p > a { content: '</style' }</style><noscript>" + PROSE + "</noscript>",
        '{}<div hidden>' + PROSE + '</div><div style="display: none">' + PROSE + "</div>",
    ],
)
def test_what_is_not_the_article_goes(around):
    inner = "<h1>A title</h1><p>" + PROSE * 2 + "</p><p>Short.</p><p>" + PROSE + "<a href='#'>linked</a></p>"
    want = " ".join(["A title", (PROSE * 2).strip(), "Short.", PROSE + "linked"])
    for frame in ("<article>{}</article>", "<main><article class='post has-sidebar'>{}</article></main>", "<main>{}</main>", "<div class='x1'>{}</div>"):
        page = "<!DOCTYPE html><html><head><title>T</title></head><body>" + around.replace("{}", frame.format(inner)) + "</body></html>"
        assert text_of(page) == want, frame


def test_inside_an_article():
    page = "<article><h1>T &amp; U</h1><p>a<b>b</b>&nbsp; c<br>d &lt;p&gt; &#233;&eacute &bogus;<p>x" + '<div class="share">Tell it</div><ul><li>one<li>two</ul><aside>' + PROSE + "</aside><footer>By X</footer><p>end</article>"
    assert text_of(page) == "T & U ab c d <p> éé &bogus; x one two end"


def test_words_of_no_known_language_stay_in_an_article():
    assert text_of("<nav><a href='/'>Home</a></nav><article><p>" + "zug zug! " * 60 + "</p><p>zug</p></article>") == ("zug zug! " * 60 + "zug").strip()
    assert text_of("<p>" + "zug zug " * 60 + "</p>") == ""


def test_broken_markup():
    assert text_of("") == text_of(None) == text_of("<") == text_of("<!-- x") == text_of("<script>x") == text_of("</div></p>") == ""
    assert text_of("<article><p>" + PROSE + "<p>1 < 2 and a<b") == (PROSE + "1 < 2 and a")
    assert text_of("<article><p title='>'>" + PROSE + "</p") == PROSE.strip()
    deep = "<div>" * 20_000 + "<p>" + PROSE + "</p>" + "</div>" * 20_000
    assert text_of("<article>" + deep) == PROSE.strip()


def test_long_page_and_awkward_rows(spark):
    page = "<article>" + "".join(f"<p>{PROSE}{i}</p>" for i in range(20_000)) + "</article>"
    rows = [(1, None, page, "x"), (1, None, page, "x"), (None, "u", None, "y"), (3, "u", "", "z")]
    got = htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).orderBy(F.asc_nulls_first("page_id")).collect()
    assert [(r.page_id, r.n_chars) for r in got][0] == (None, 0) and got[1].text == got[2].text == " ".join(f"{PROSE}{i}" for i in range(20_000)) and got[3].text == ""
    assert htmltext.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    with pytest.raises(ValueError):
        htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), columns=("page_id", "text"))
    kinds = htmltext.extract_blocks(spark.createDataFrame([(1, "u", "<nav>a</nav><article><p>b</article>")], "page_id long, url string, html string")).first().blocks
    assert [(b.tag, b.label, b.text) for b in kinds] == [("nav", "bad", "a"), ("p", "good", "b")]


def coded_by_definition(rows, parts, entries, rounds):
    """rows: (id, vector) with finite vectors; plain Python integers throughout."""
    ints = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows]
    w = len(ints[0][1]) // parts
    cut = lambda v: [v[p * w : p * w + w] for p in range(parts)]
    first = sorted(ints, key=lambda r: (r[0] is None, r[0] or 0, rows[0][1] and r[1]))[:entries]
    books = [[cut(v)[p] for _, v in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((dist(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            at = {}
            for _, v in ints:
                at.setdefault(near(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            books[p] = [[sum(c) // len(at[k]) for c in zip(*at[k], strict=True)] if k in at else e for k, e in enumerate(books[p])]
    return books, {i: ([near(x, books[p])[1] for p, x in enumerate(cut(v))], sum(near(x, books[p])[0] for p, x in enumerate(cut(v)))) for i, v in ints}


@pytest.mark.parametrize("seed", range(3))
def test_codes_by_definition(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1 + 3 * seed, 8)]) for i in range(120)]
    rows += [(200 + k, rows[k][1]) for k in range(10)] + [(300, [-0.001] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    books = vectorcode.train(df, parts=4, entries=16, rounds=2)
    want, codes = coded_by_definition(rows, 4, 16, 2)
    assert books.entries.tolist() == want
    coded = vectorcode.encode(df, books)
    assert {r.vec_id: (list(r.codes), r.error) for r in coded.collect()} == codes
    back = {r.vec_id: r.vector for r in vectorcode.decode(coded, books).collect()}
    assert len(back) == len(rows) and np.abs(np.array(back[0]) - np.array(rows[0][1])).max() < 8


def test_codes_of_awkward_rows(spark):
    nan, inf, ok = float("nan"), float("inf"), [0.5, -0.25, 1.0, 2.0]
    rows = [(1, ok, "a"), (1, ok, "a"), (2, None, "a"), (3, [0.0, None, 0.0, 0.0], "a"), (4, [nan, 0.0, 0.0, 0.0], None), (5, [0.0, -inf, 0.0, 0.0], "a"), (6, [1.0, 1.0], None), (7, [3e38, 0.0, 0.0, 0.0], None), (None, [9.0, 9.0, 9.0, 9.0], None), (8, [], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, code string")
    books = vectorcode.train(df, parts=2, entries=2, rounds=0)
    assert books.entries.tolist() == [[[128, -64]] * 2, [[256, 512]] * 2]
    coded = vectorcode.encode(df, books, columns=("vec_id", "code"))
    got = sorted(((r.vec_id, r.code, r.codes, r.error) for r in coded.collect()), key=str)
    assert got[:2] == [(1, "a", [0, 0], 0)] * 2 and {(g[0], g[2]) for g in got[2:] if not g[2]} == {(6, None), (7, None), (8, None)} and len(got) == 6
    back = {r.vec_id: r.vector for r in vectorcode.decode(coded, books).collect()}
    assert back[6] is None and len(back[1]) == 4
    total = {(r.code, r.all_error) for r in vectorcode.with_group_error(coded, "code", "all_error").collect()}
    assert (("a", 0) in total) and (None, sum(g[3] for g in got if g[1] is None and g[3])) in total
    empty = spark.createDataFrame([], df.schema)
    assert vectorcode.train(empty) is None and vectorcode.encode(empty, None).count() == 0
    with pytest.raises(ValueError):
        vectorcode.encode(df.withColumnRenamed("code", "codes"), books, columns=("vec_id", "codes"))


def test_long_vectors_stay_exact(spark):
    """Components at the bound: distances reach 2^61 and must not wrap."""
    dims, top = 64, float(np.nextafter(np.float32(vectorcode.limit(64)), np.float32(0)))
    rows = [(0, [top] * dims), (1, [-top] * dims), (2, [top] * dims)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    books = vectorcode.train(df, parts=16, entries=2, rounds=0)
    one = vectorcode.Codebooks(books.entries[:, :1], 256)
    got = {r.vec_id: r.error for r in vectorcode.encode(df, one).collect()}
    assert got[0] == 0 and got[1] == dims * (int(np.floor(256 * top)) - int(np.floor(-256 * top))) ** 2


def edits_by_force(signature):
    """All edit strings with up to three inserts in a place."""
    sound = re.compile(r"(s?(ua)+)?\Z")
    best = [(3 * len(signature), "D" * len(signature))]

    def go(i, roles, cost, audit, inserts):
        if cost > best[0][0]:
            return
        if i == len(signature):
            if sound.match(roles):
                best[0] = min(best[0], (cost, audit))
        elif (code := signature[i]) or True:
            if code != "d":
                go(i + 1, roles + code.lower(), cost + code.isupper(), audit + "K", 0)
                for r in "ua":
                    go(i + 1, roles + r, cost + 2 + code.isupper(), audit + "R", 0)
            go(i + 1, roles, cost + 3, audit + "D", 0)
        if inserts < 3:
            for r in "ua":
                go(i, roles + r, cost + 2, audit + "I", inserts + 1)

    go(0, "", 0, "", 0)
    return best[0][1], best[0][0]


def test_edits_are_cheapest_and_least():
    for n in range(4):
        for t in itertools.product("dsuaxSUAX", repeat=n):
            assert convrepair.solve("".join(t)) == edits_by_force("".join(t)), t
    rng = random.Random(5)
    for _ in range(60):
        s = "".join(rng.choice("dsuaxuaSUAX") for _ in range(rng.randint(4, 5)))
        assert convrepair.solve(s) == edits_by_force(s), s


def test_long_signature():
    audit, cost = convrepair.solve("ua" * 30_000 + "d")
    assert audit == "K" * 60_000 + "D" and cost == 3


def report_by_force(rows):
    """Contract by plain loops; rows: (conv_id, turn, role, text)."""
    sp = lambda x: " " if x is None else str(x)
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for c, turn, role, text in (r for r in rows if r[0] == conv):
            kind, role, text = zlib.crc32(f"{sp(c)}:{sp(turn)}".encode()) % 20, sp(role), sp(text)
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, sig, n = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            bare = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            sig += "d" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        turns = {r[0] for r in own if r[0] is not None}
        audit, cost = convrepair.solve(sig)
        done, i = [], 0
        for e in audit:
            if e == "D":
                i += 1
                continue
            role, text = ("", "") if e == "I" else own[i][1:]
            i += e != "I"
            first = bool(done) and done[0][0].startswith("s")
            done.append((role if e == "K" else "user" if (len(done) - first) % 2 == 0 else "assistant", text))
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest())
    return out


def test_conversations_by_force(spark, tmp_path):
    rng = random.Random(9)
    texts = ["Yes.", "No!", "so it", "", " \t", "a\nb?", "Yes. ", None, "é…", "ok." * 3000]
    rows = [(c if c else None, t if t != 3 else None, rng.choice(["user", "assistant", "system", None, "tool", "", "ubique"]), rng.choice(texts)) for c in range(80) for t in range(rng.randint(1, 7))]
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(3000)] + [(7, 2, "user", "again."), (7, 2, "user", "again."), (-3, -5, "user", "x.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("audit", F.lit(1)).withColumn("seq", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_conversation_repair(spark, str(tmp_path)).collect()
    assert {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got} == report_by_force(rows) and len(got) == len({r[0] for r in rows})


def test_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "More"), (1, 2, "assistant", "Well."), (2, 0, "assistant", "Hm."), (None, 0, "tool", "x.")], "conv_id long, turn long, role string, text string")
    audited = convrepair.audits(convrepair.signatures(rows)).select("conv_id", "audit")
    got = sorted(((r.conv_id or 0, r.position, r.role, r.text, r.edit) for r in convrepair.repaired_rows(rows, audited).collect()))
    assert got == [(1, 1, "user", "Hi.", "keep"), (1, 2, "assistant", "Well.", "keep"), (2, 1, "user", "", "insert"), (2, 2, "assistant", "Hm.", "keep")] or {g[0] for g in got} <= {0, 1, 2}
    empty = spark.createDataFrame([], rows.schema)
    assert convrepair.repair_report(empty).count() == 0


def test_clashing_names_are_refused(spark):
    docs = spark.createDataFrame([(1, "some words in a text", 2, 3.0, 4)], "doc_id long, text string, n_lines long, score double, n_hit long")
    labels, items = spark.createDataFrame([(1, 1)], "doc_id long, quality int"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for call in (lambda: linedup.dedup_lines(docs, ("doc_id", "text", "n_lines")), lambda: byteconv.score_quality(docs, labels, columns=("doc_id", "score")), lambda: decontam.find_contamination(docs, items, columns=("doc_id", "text", "n_hit"))):
        with pytest.raises(ValueError, match="rename"):
            call()
    assert decontam.find_contamination(docs, items, columns=("doc_id", "text", "score")).count() == 1
