import random

from tersa.llm import line_dedup

from .test_dedup_and_scoring import brute_lines


def removed(docs_of, lines):
    rows = line_dedup.decide(docs_of(list(enumerate(lines)))).collect()
    return {r.doc for r in rows if r.removed}


def test_characters_past_the_start_of_a_word_count(docs_of):
    lines = ["https://www.a.org/x", "https://www.b.net/y", "identifier_0000001 identifier_0000002", "identifier_0345678 identifier_0987654"]
    assert removed(docs_of, lines) == set()


def test_lines_with_a_common_start_stay(docs_of):
    lines = ["https://example.com/cats", "https://example.com/dogs", "internationalisation", "internationality"]
    lines += ["今天天气很好我们一起去公园散步吧", "今天天气很好但是我必须留在家里工作", "short"]
    assert removed(docs_of, lines) == set()


def test_a_group_of_near_copies_without_a_line_that_all_are_like(docs_of):
    """A chain: each line is like the next one only, so the hub is like few, and pages find the other links."""
    rng = random.Random(7)
    line, lines = [rng.choice("abcdefghijklmnop") for _ in range(220)], []
    for at in range(0, 200, 12):
        line = [*line[:at], *(rng.choice("qrstuvwxyz") for _ in range(8)), *line[at + 8 :]]
        lines.append("".join(line))
    want, links = brute_lines(list(enumerate(lines)), 80)
    assert removed(docs_of, lines) == {d for d, _ in want} and len(want) > 10 and links < len(lines) * 3


def test_every_character_has_a_shingle(spark):
    lines = ["", "short", "ninechars", "one-token/without.spaces", "two words \U0001f600\U0001f600 and more"]
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    got = {r.line: r.s for r in frame.select("line", line_dedup.shingles(frame["line"]).alias("s")).collect()}
    spelled = {x: x.encode("utf-16-be") for x in lines}
    assert got == {x: [b[2 * i : 2 * i + 18] for i in range(max(1, len(b) // 2 - 8))] for x, b in spelled.items()}


def test_long_tokens_that_differ_a_little_are_one(docs_of):
    token = "".join(chr(97 + i * i * 7 % 26) + str(i) for i in range(80))
    assert removed(docs_of, [token, token[:-1] + "Z", token[::-1]]) == {1}


def test_white_space_runs_are_one_space(docs_of):
    line = "the same line of words in other white space"
    assert removed(docs_of, [line, line.replace(" ", "  "), f"\t{line.upper()} ".replace(" ", " \t\x0b")]) == {1, 2}


def test_lines_against_every_pair(docs_of):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    stock = [rng.choice(["", " "]).join(word() for _ in range(rng.randrange(12, 40))) for _ in range(40)]
    rows = []
    for d in range(120):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            x = rng.choice(stock)
            for _ in range(rng.choice([0, 1, 2])):
                at = rng.randrange(len(x))
                x = x[:at] + word() + x[at + 5 :]
            lines.append(x.replace(" ", rng.choice([" ", "  ", "\t", " \r\x0b"])))
        rows.append((d, "\n".join(lines)))
    want, links = brute_lines(rows, 80)
    got = {(r.doc, p) for r in line_dedup.decide(docs_of(rows)).collect() for p in r.removed}
    assert links > 20 and 50 < len(want) < sum(t.count("\n") + 1 for _, t in rows)
    assert len(got ^ want) <= 0.01 * len(want)
