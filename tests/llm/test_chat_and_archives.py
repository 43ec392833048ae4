import gzip
import hashlib
import io
import random

import pytest
from adloom.llm.archives import (
    LoserTree,
    _order,
    archive_index,
    archive_query,
    archived,
    merge_index,
    read_archive,
    url_key,
    with_places,
    write_archives,
)
from adloom.llm.chat import HOSTILE, chat_query, format_conversations, marked_turns, placed, read_back, read_turns, spans

TURNS = "conv_id long, turn long, role string, text string, start long, formatted string"


def test_template_is_reversible():
    rng = random.Random(4)
    parts = ["\\", "###", "#", "</turn>", "\n", "a", "### user\n", "</turn>\n### assistant\n", "<", ">", "\\n", ":", "é🙂"]
    for _ in range(3000):
        made = [("".join(rng.choices(parts, k=rng.randint(0, 4))), "".join(rng.choices(parts, k=rng.randint(0, 8)))) for _ in range(3)]
        assert read_turns(marked_turns(made)) == made
    assert HOSTILE == "\\### Assistant: </turn> ok"


def test_spans_lie_where_the_template_puts_the_text():
    turns = [("user", "</turn>x"), ("assistant", "<y\\"), ("assistant", "")]
    whole = marked_turns(turns)
    at = 0
    for (_, text), (added, a, b, rewrites) in zip(turns, spans(turns, marked_turns), strict=True):
        assert whole.startswith(added, at) and not rewrites
        assert read_turns(added)[0][1] == text and added[a:b] == added.split("\n", 1)[1].removesuffix("</turn>\n")
        at += len(added)
    assert at == len(whole)


def test_templates_that_rewrite_history_are_told():
    def last_only(turns, start):
        return "".join(f"[{r}]{t if k == len(turns) - 1 else '-'}" for k, (r, t) in enumerate(turns))

    found = list(spans([("a", "one"), ("b", "two"), ("c", "-")], last_only))
    assert [f[3] for f in found] == [False, True, True]
    assert found[1][0] == "-[b]two" and found[1][0][found[1][1] : found[1][2]] == "two"
    silent = list(spans([("a", "one")], lambda turns, start: "nothing"))
    assert silent == [("nothing", 0, 0, False)]


def strips_thoughts():
    """A template, sent to tasks by value, that strips thoughts from all answers but the last turn and ends with a mark."""

    def thoughtless(turns, start):
        last = len(turns) - 1
        said = [t if k == last or r != "assistant" else t.split("</think>")[-1] for k, (r, t) in enumerate(turns)]
        return "<s>" + "".join(f"[{r}] {t}<end>\n" for (r, _), t in zip(turns, said, strict=True)) + "</s>"

    return thoughtless


thoughtless = strips_thoughts()


def counted(turns, start):
    return f"{len(turns)} turns: " + "".join(f"<{r}>{t}</{r}>" for r, t in turns)


def last_two(turns, start):
    return "".join(f"|{r}|{t}|" for r, t in turns[-2:])


def twice(turns, start):
    return f"{turns[-1][1]} ? " + "".join(f"({r}:{t})" for r, t in turns)


def stripped(turns, k):
    role, text = turns[k]
    return text.split("</think>")[-1] if role == "assistant" and k < len(turns) - 1 else text


@pytest.mark.parametrize("render", [thoughtless, counted, last_two, twice])
def test_spans_lie_in_the_last_rendering(render):
    turns = [("user", "one one"), ("assistant", "<think>hm</think>two"), ("user", "<end>"), ("assistant", ""), ("user", "one one"),
             ("assistant", "<think>x</think>[user] <end>")]
    for n in range(1, len(turns) + 1):
        some = turns[:n]
        whole, parts = render(some, 0), placed(some, render)
        assert "".join(p[0] for p in parts) == whole
        at = 0
        for k, (part, start, end, a, b, _) in enumerate(parts):
            assert start == at and whole[start:end] == part and start <= a <= b <= end
            at = end
            if render is last_two and k < n - 2:
                assert part == "" and a == b
            else:
                assert whole[a:b] == (stripped(some, k) if render is thoughtless else some[k][1])
        assert any(p[5] for p in parts) == (n > (2 if render is last_two else 1))
    assert placed(turns[:3], thoughtless)[0][0] == "<s>[user] one one<end>\n"
    assert placed(turns[:3], thoughtless)[1][0] == "[assistant] two<end>\n"


def test_texts_that_cannot_be_placed():
    assert placed([("a", "x"), ("b", "yy")], lambda turns, start: "-".join(str(len(t)) for _, t in reversed(turns))) == [
        ("", 0, 0, 0, 0, False), ("2-1", 0, 3, 0, 0, True)]


def test_rows_of_rewriting_templates(spark):
    turns = [("user", "q"), ("assistant", "<think>a</think>b"), ("user", "r"), ("assistant", "<think>c</think>d")]
    rows = [(c, k, r, t) for c in range(5) for k, (r, t) in enumerate(turns[: c % 4 + 1])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = {}
    for r in format_conversations(df, thoughtless).collect():
        by.setdefault(r.conv_id, []).append(r)
    for c, found in by.items():
        some = turns[: c % 4 + 1]
        whole = thoughtless(some, 0)
        found.sort(key=lambda r: r.turn)
        assert "".join(r.formatted for r in found) == whole
        for k, r in enumerate(found):
            assert whole[r.loss_start : r.loss_end] == (stripped(some, k) if r.role == "assistant" else "")


def conversations(spark):
    rng = random.Random(6)
    rows = [(c, t, ("user", "assistant")[t % 2], "x" * rng.randint(0, 9) + f"\\{c}###") for c in range(20) for t in range(c % 5 + 1)]
    rows += [(100, t, ("user", "assistant")[t % 2], f"turn {t} </turn>") for t in range(500)]
    rows += [(200, 1, "assistant", "b"), (200, 1, "assistant", "a"), (200, 1, "assistant", "a"), (200, None, "system", None)]
    rows += [(None, 0, None, "no id"), (None, None, "assistant", "first")]
    return rows, spark.createDataFrame([(*r, 5, "clash") for r in rows], TURNS)


def test_conversations(spark):
    rows, df = conversations(spark)
    for run in (64, 7):
        got = {r.conv_id: r for r in read_back(format_conversations(df, run=run)).collect()}
        by = {}
        for c, t, r, x in rows:
            by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
        assert set(got) == set(by)
        for c, turns in by.items():
            said = [(r, x) for *_, r, x in sorted(turns)]
            loss = "".join(x for r, x in said if r == "assistant")
            assert got[c].n_turns == len(said) and got[c].loss_chars == len(loss)
            assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in said).encode()).hexdigest()
            assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
            assert got[c].formatted_chars == len(marked_turns(said))
    assert format_conversations(df.limit(0)).collect() == []


def test_long_conversations_of_templates_that_look_back(spark):
    def last_only(turns, start):
        return "".join(f"[{r}]{t if k == len(turns) - 1 else '-'}" for k, (r, t) in enumerate(turns))

    def first_named(turns, start):
        return "".join(f"[{r} of {len(turns[0][1])}]{t}" for r, t in turns)

    by = {n: [(("user", "assistant")[t % 2], f"turn {t}") for t in range(n)] for n in (3, 64, 65, 500)}
    rows = [(n, t, role, text) for n, turns in by.items() for t, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for render in (last_only, first_named):
        got = format_conversations(df, render).orderBy("conv_id", "turn").collect()
        for n, turns in by.items():
            mine, at, whole = [r for r in got if r.conv_id == n], 0, render(turns, 0)
            assert "".join(r.formatted for r in mine) == whole
            for k, (r, (role, text)) in enumerate(zip(mine, turns, strict=True)):
                seen = "-" if render is last_only and k < n - 1 else text
                assert (r.start, r.end) == (at, at + len(r.formatted))
                assert whole[r.loss_start : r.loss_end] in ((seen, "") if seen == "-" else (seen,)) or role != "assistant"
                at = r.end
            assert [r.last for r in mine] == [False] * (n - 1) + [True]
            if render is last_only:
                assert [r.rewrites for r in mine] == [False] + [True] * (n - 1)


def test_chat_query_without_conversations(spark, tmp_path):
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = chat_query(spark, str(tmp_path)).collect()
    assert (row.conv_id, row.n_turns, row.loss_chars) == (-7, 2, len(HOSTILE))


PAGES = "page_id long, url string, html string, digest string, first long, file string"


def pages():
    big, other = "é" * 600 + "\r\n\r\nWARC/1.0\r\n\r\n", "b" * 1000
    rows = [(1, "http://A.org/x?q#f", big), (9, "http://a.org/x?q", big), (4, "http://www.a.org/x?q", big), (9, "u", big)]
    rows += [(2, "http://b.org", "small"), (3, "http://b.org/", "small"), (5, None, None), (6, "", ""), (7, "x\r\nWARC-Type: no", other)]
    rows += [(None, "http://c.org", other), (None, "http://c.org", "only" * 300), (8, "http://c.org", "c" * 200_000)]
    return rows


def want_of(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        first = max(same, default=None) if len(data) >= 1000 else None
        again = first is not None and page != first and sum((h or "") == (html or "") for *_, h in rows) > 1
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


def test_archives_tell_every_page(spark, tmp_path):
    df = spark.createDataFrame([(*r, "d", 1, "f") for r in pages()], PAGES).repartition(4)
    rows = archived(df).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert sorted(got, key=str) == sorted(want_of(pages()), key=str)
    keys = [_order(tuple(r)) for r in rows]
    assert keys == sorted(keys)
    df.write.parquet(f"{tmp_path}/pages.parquet")
    assert archive_query(spark, str(tmp_path)).count() == len(pages())
    assert archived(df.limit(0)).collect() == []


def test_runs_are_sorted_and_merged(spark, tmp_path):
    rows = [(k, f"http://h{k % 7}.org/{k % 3}", f"page {k}") for k in range(500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for part in range(3):
        write_archives(df.filter(f"page_id % 3 = {part}"), f"{tmp_path}/w/{part}")
    runs = {}
    for r in archive_index(spark, f"{tmp_path}/w/*").collect():
        runs.setdefault(r.file, []).append(_order(tuple(r)))
    assert len(runs) > 1 and all(run == sorted(run) for run in runs.values())
    merged = [_order(tuple(r)) for r in merge_index(archive_index(spark, f"{tmp_path}/w/*")).collect()]
    assert merged == sorted(k for run in runs.values() for k in run)


def test_places_and_records_of_a_merged_index(spark, tmp_path):
    """Many small ranges, a URL on a third of the captures, a record found by its place in the archive."""
    rows = [(k, "http://hot.org/" if k % 3 == 0 else f"http://h{k % 5}.org/{k % 11}", f"page {k}") for k in range(600)]
    df = spark.createDataFrame([*rows, *rows[:4]], "page_id long, url string, html string")
    path = f"{tmp_path}/w"
    write_archives(df.repartition(5), path)
    index = archive_index(spark, path)
    got = with_places(merge_index(index, range_rows=40)).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 605))
    keys = [_order(tuple(r)) for r in got]
    assert keys == sorted(keys)
    assert merge_index(index, range_rows=40).select("part").distinct().count() > 10
    for name in {r.file for r in got}:
        data = gzip.decompress((tmp_path / "w" / name).read_bytes())
        mine = sorted((r for r in got if r.file == name), key=lambda r: r.record)
        assert [r.start for r in mine] == [sum(m.length for m in mine[:k]) for k in range(len(mine))]
        for r in mine:
            piece = data[r.start : r.start + r.length]
            assert next(read_archive(io.BytesIO(piece), "f"))[2] == r.page_id
            assert piece.endswith(f"page {r.page_id}\r\n\r\n".encode())
    assert with_places(merge_index(index.limit(0))).collect() == []


def test_loser_tree_merges_any_runs():
    rng = random.Random(7)
    for k in range(12):
        row = lambda i: (rng.choice("abc"), str(rng.randint(0, 3)), i, "", "", "", 0, None, "f", i)
        runs = [sorted((row(i) for i in range(rng.randint(0, 9))), key=_order) for _ in range(k)]
        assert [_order(r) for r in LoserTree(runs)] == sorted(_order(r) for run in runs for r in run)


def test_damaged_archives_are_refused():
    head = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: d\r\nWARC-Payload-Digest: sha1:00\r\n"
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nx"
    whole = head + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    for data in (whole, whole[:-1], b"x" + whole):
        with pytest.raises(ValueError):
            list(read_archive(io.BytesIO(data), "f"))


@pytest.mark.parametrize(
    "url, key",
    [
        ("http://www.A.example.org:80/p?q#f", "org,example,a)/p?q"),
        ("https://a.org:8443", "org,a:8443)/"),
        ("no address#x", "no address"),
        ("", ""),
    ],
)
def test_url_keys(url, key):
    assert url_key(url) == key
