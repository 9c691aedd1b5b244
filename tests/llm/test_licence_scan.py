import random

from tidewake.llm import licence_scan as ls


def test_base_places_match_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    words = "the mit license apache general public x MIT License. GPL, of\nfree éa".split(" ")
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "--- \n"), (None, "Apache License"), (503, "mit mit license license"), (504, "x " * 50_000 + "MIT LICENSE"), (505, "émit license"), (506, "mit-license")]
    for block in (1 << 20, 16):
        monkeypatch.setattr(ls, "BLOCK", block)
        scanner = ls.Scanner()
        for _, t in rows:
            assert sorted(scanner.scan((t or "").encode())[1]) == ls.base_places(t or "")
    got = {r.doc_id: r for r in ls.scan_licences(spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, labels string, score int")).collect()}
    assert (got[500].n_words, got[500].n_base, got[500].first_word, got[500].labels, got[500].score) == (0, 0, None, "", 0.0)
    assert (got[504].n_words, got[504].first_word, got[504].last_word, got[504].base_labels) == (50_002, 50_000, 50_000, "mit")
    assert got[None].base_labels == "apache" and got[503].n_base == 1 and got[505].n_base == 0 and got[506].n_base == 1
    assert ls.scan_licences(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_spans_survive_small_edits_and_ignore_prose():
    scanner = ls.Scanner()
    apache = next(t for t, _ in ls.TEMPLATES if t.startswith("unless required"))
    words = apache.split()
    edited = " ".join(words[:12] + ["quite"] + words[12:])
    for text, label in ((apache, "apache"), (edited, "apache"), ("Foo. " + apache.upper() + " bar", "apache"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc")):
        spans = scanner.scan(text.encode())[2]
        assert label in {s[0] for s in spans}, text
    assert scanner.scan(edited.encode())[2][0][1:3] == (0, len(words))
    assert scanner.scan(b"Permission is granted to the software people and the copy of this is in the notes")[2] == []
    assert scanner.scan(" ".join(words[: len(words) // 2]).encode())[2] == []


def test_matching_statistics_are_longest_matches():
    rng = random.Random(7)
    strings = [[rng.choice("abc") for _ in range(rng.randrange(1, 12))] for _ in range(12)]
    sam = ls.SuffixAutomaton()
    for i, s in enumerate(strings):
        sam.add(i, s)
    sam.finish()
    for _ in range(200):
        text = [rng.choice("abcd") for _ in range(20)]
        state = length = 0
        for i, c in enumerate(text):
            state, length = sam.step(state, length, c)
            want = max((k for k in range(i + 2) if any(text[i + 1 - k : i + 1] == s[j : j + k] for s in strings for j in range(len(s) - k + 1))), default=0)
            assert length == want
            run = text[i + 1 - length : i + 1]
            for number, s in enumerate(strings if state else []):
                assert sam.ends[state].get(number, set()) == {j + length - 1 for j in range(len(s) - length + 1) if s[j : j + length] == run}


def test_a_repeated_phrase_chains_at_its_later_place():
    """The second "a b c d" of the template goes on from "p q r s", however it is set off in the text."""
    for template in ("a b c d p q r s a b c d t u v w", "a b c d p q r s t u v w"):
        scanner = ls.Scanner(templates=((template, "x"),), base=())
        text = "a b c d p q r s z a b c d z t u v w" if template.count("a b c d") == 2 else "a b c d p q r s z t u v w"
        n, places, spans = scanner.scan(text.encode())
        assert (n, places) == (len(text.split()), []) and [(s[0], s[1], s[2]) for s in spans] == [("x", 0, n - 1)] and spans[0][3] == 1.0


def test_two_copies_are_two_spans():
    notice = ls.TEMPLATES[1][0]
    _, _, spans = ls.Scanner().scan(f"Intro words. {notice}. Other words stand between here, a dozen of them, so that gaps are wide. {notice}".encode())
    assert [s[0] for s in spans].count("mit") == 2
