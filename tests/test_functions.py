"""Golden values and properties of the sequence functions."""

import random
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.functions import align, prose
from quillspark.sources import epub
from quillspark.streaming import queue


def test_words():
    assert align.words("“Don’t” re-\n  turn, 'x'") == ["don't", "return", "x"]


def test_skeleton():
    assert align.skeleton("pharmácia") == align.skeleton("farmacia")
    assert align.skeleton("Theatro") == "teatro"


def test_combine_keeps_white_space():
    assert align.combine("a farmacia\n\n nova casa", "a pharmacia velha casa") == "a pharmacia\n\n nova casa"


def test_cut_repetition():
    rng = random.Random(1)
    body = " ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(80)) + "."
    assert align.cut_repetition(body + "\n" + body).startswith(body[:400])
    assert len(align.cut_repetition(body + "\n" + body)) <= len(body) + 1
    assert align.cut_repetition(body) == body


def edition(blocks, copy_text):
    """Outcomes and differences by block, and what only the copy has."""
    copy = align.words(copy_text)
    placed = align.place_blocks([align.words(align.strip_markdown(t)) for _, t in blocks], copy)
    ids = [b for b, _ in blocks]
    changed = {b: align.differences(p.ours, p.theirs) for b, p in zip(ids, placed) if p.outcome == "located"}
    outcomes = {b: ("different" if changed[b] else "equal") if b in changed else p.outcome for b, p in zip(ids, placed)}
    return outcomes, changed, align.leftovers(ids, placed, copy)


def test_editions_word_changed_block_cut_and_passage_added():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijlmnoprstuv") for _ in range(rng.randint(4, 9))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = [f"{say(40)} coisa bem específica {say(20)}." for _ in range(30)]
    blocks = [(f"b{n}", t) for n, t in enumerate(base, 1)]
    outcomes, _, extra = edition(blocks, "\n\n".join(base))
    assert set(outcomes.values()) == {"equal"} and not extra
    other = list(base)
    other[4] = other[4].replace("bem específica", "muito vaga")
    del other[9]
    other.insert(20, "Este trecho inteiro só existe na outra edição. " * 12)
    outcomes, changed, extra = edition(blocks, "\n\n".join(other))
    assert {b: o for b, o in outcomes.items() if o != "equal"} == {"b5": "different", "b10": "absent"}
    assert changed["b5"][0][:3] == ("replace", "bem específica", "muito vaga") and len(changed["b5"][0][3].split()) == 6
    assert [(x.after, x.before, x.words) for x in extra] == [("b21", "b22", 96)]
    # Short blocks between located ones: equal, one word changed, cut; without words not compared.
    titled = [*blocks[:3], ("t1", "## Capítulo dois"), *blocks[3:6], ("t2", "Maio de 1925"), *blocks[6:9], ("t3", "Uma linha curta"), ("t4", "* * *"), *blocks[9:]]
    outcomes, changed, _ = edition(titled, "\n\n".join([*base[:3], "Capítulo dois", *base[3:6], "Junho de 1925", *base[6:]]))
    assert {b: o for b, o in outcomes.items() if o != "equal"} == {"t2": "different", "t3": "absent", "t4": "not compared"}
    assert changed["t2"] == [("replace", "maio de 1925", "junho de 1925", "")]
    assert edition(blocks[:2], "") == ({"b1": "absent", "b2": "absent"}, {}, []) and edition([], "a b c")[0] == {}


def test_alignment_of_many_equal_words_is_difflibs(monkeypatch):
    """Runs held as arrays give difflib's blocks, also where they are looked at in parts; a part's longest run is not looked for pair by pair."""
    rng = random.Random(5)
    monkeypatch.setattr(align, "MANY", 1)
    for k in range(300):
        monkeypatch.setattr(align, "PART", rng.choice([3, 50, 10**6]))
        say = lambda n: [str(rng.randrange(1 + k % 9)) for _ in range(n)]
        a = say(rng.randint(0, 40))
        b = a[: rng.randint(0, 40)] + say(rng.randint(0, 9)) + a[rng.randint(0, 40) :]
        own, other = align.Alignment(a, b), SequenceMatcher(None, a, b, autojunk=False)
        assert own.get_matching_blocks() == other.get_matching_blocks() and own.ratio() == other.ratio()
    monkeypatch.undo()
    a = [rng.choice("abcdefghij") for _ in range(5000)]
    b = [w for k, w in enumerate(a) if k % 10]
    monkeypatch.setattr(SequenceMatcher, "find_longest_match", None)
    assert align.ratio(a, b) > 0.9


def test_words_and_markdown():
    assert align.words("suffe-\nring “Aspas” — fim.") == ["suffering", "aspas", "fim"] and align.words("‘hbd’ don't ' x") == ["hbd", "don't", "x"]
    plain = align.words(align.strip_markdown("1.  Um item. 2.  Outro, de 1930. 3.0 fica."))
    assert plain == ["um", "item", "outro", "de", "1930", "3", "0", "fica"]
    assert align.words(align.strip_markdown("a [b c](http://x.y/(z)) *d*[^1] <br> # e")) == ["a", "b", "c", "d", "e"]


def test_join_lines():
    assert prose.join_lines(["reconheci-", "mento"]) == "reconhecimento"
    assert prose.join_lines(["obriga-", "se"]) == "obriga-se"
    assert prose.join_lines(["a", " ", "b"]) == "a b"
    assert prose.join_lines(["government-", "sanctioned"], {"government": 2, "sanctioned": 3}) == "government-sanctioned"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc *[](x)^1 ", max_size=80))
def test_unmask_inverts_mask(text):
    assert prose.unmask(*prose.mask(text)) == text


def test_mask():
    assert prose.mask("a [b](u) **c** *d* [^1]") == ("a <a1>b</a1> <b3>c</b3> <i4>d</i4> <n2/>", ["u", "[^1]", "**", "*"])


def test_mobi_and_atom():
    assert prose.mobi_titles('<p><font size="7"><b>T</b></font></p>') == "<h1>T</h1>"
    assert prose.mobi_titles('<p a="b"> <b><font size="4">T <i>u</i></font></b> </p>') == "<h4>T <i>u</i></h4>" and prose.mobi_titles('<p><font size="9"><b>T</b></font></p>') == "<h1>T</h1>"
    for small in ('<p><font size="3"><b>T</b></font></p>', f'<p><font size="7"><b>{"x" * 201}</b></font></p>', '<p><font size="7"><b> </b></font></p>'):
        assert prose.mobi_titles(small) == small
    feed = "<feed><entry><id>x/ebooks/7.opds</id><title>T (French)</title></entry></feed>"
    assert prose.atom_entries(feed) == [("7", "T", "French")]


def test_epub_follows_the_spine():
    assert [b for _, b in epub.chapters(epub.pack(["one", "two", "three"]))] == ["<p>one</p>", "<p>two</p>", "<p>three</p>"]


def test_queue():
    state = queue.State()
    for event in ("signup", "signup", "purchase", "error"):
        state = queue.step(state, event)
    assert state == queue.State(0, 0, 1, 1, False)


def test_queue_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_id", "ts", "event_type")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = queue.stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("update").format("memory").queryName("books").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {r["user_id"]: tuple(r)[1:] for r in spark.table("books").collect()}
    want = {r["user_id"]: tuple(r)[1:] for r in events.groupBy("user_id").applyInPandas(queue.replay, queue.SCHEMA).collect()}
    assert got == want
