import random
import re

from palimpsest.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, position string, place string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_links_and_order(spark):
    rows = [
        (1, 0, "user", "Hello there. How are you today?"), (1, 1, "assistant", "I am fine."),
        (1, 2, "user", "On Monday X wrote:\n> Hello there.\n> How are\n> you today?\nGreat."),
        (1, 3, "user", "> > Hello there.\n> I am fine.\nok"), (1, 4, "user", "> never said\nhm"),
        (2, 0, "user", "> I AM  fine.\nnew thread"), (3, 0, None, None), (4, 0, "user", "I am fine."), (4, 1, "user", "> I am fine.\nso"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in chat.threads(frame(spark, rows)).collect()}
    reply = {k: (r["reply_conv"], r["reply_turn"]) for k, r in got.items() if r["reply_conv"] is not None}
    assert reply == {(1, 2): (1, 0), (1, 3): (1, 1), (2, 0): (1, 1), (4, 1): (4, 0)}
    assert got[1, 2]["text"] == "Great." and got[1, 2]["message"] == "<|user|>\nGreat.\n"
    assert (got[1, 3]["levels"], got[1, 3]["n_quoted"], got[1, 3]["n_linked"]) == (2, 2, 2)
    assert (got[1, 4]["n_quoted"], got[1, 4]["n_linked"]) == (1, 0)
    assert {k: r["thread_id"] for k, r in got.items() if k[0] in (2, 3, 4)} == {(2, 0): 1, (3, 0): 3, (4, 0): 4, (4, 1): 4}
    assert [got[1, t]["position"] for t in range(5)] + [got[2, 0]["position"]] == list(range(6))
    for k, (c, t) in reply.items():
        assert got[k]["position"] > got[c, t]["position"] and got[k]["thread_id"] == got[c, t]["thread_id"]


def test_a_hot_conversation_keeps_its_order(spark):
    rows = [(5, t, "user", f"say {t}. Yes.") for t in range(3000)] + [(c, 0, "user", "Yes.") for c in range(100, 400)] + [(5, 3000, "user", "> say 17.\n> Yes.\nno")]
    got = chat.threads(frame(spark, rows).repartition(6))
    hot = {r["turn"]: r["position"] for r in got.where("conv_id = 5").collect()}
    assert hot == {t: t for t in range(3001)}
    # "Yes." is first said in turn 0, "say 17." in turn 17: a tie goes to the later
    assert got.where("conv_id = 5 and turn = 3000").first()["reply_turn"] == 17


def test_awkward_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "> a\nb"), (None, None, None, None), (2, None, "user", ""), (3, 0, "user", "> only a quote"), (4, 0, "user", ">" * 50 + " deep\n" + "x " * 50_000)]
    got = chat.threads(frame(spark, rows))
    assert got.count() == len(rows)
    assert sorted(r["position"] for r in got.where("conv_id = 1").collect()) == [0, 1]
    assert got.where("conv_id = 3").first()["text"] == "" and got.where("conv_id = 4").first()["levels"] == 50
    assert chat.threads(frame(spark, rows).limit(0)).count() == 0


def test_quotes_of_other_conversations_nested_and_apart(spark):
    rows = [
        (3, 0, "user", "On Mon A wrote:\n> On Sun B wrote:\n> > How is it?\n> I agree.\nMe too."), (7, 0, "user", "How is it?"), (7, 1, "user", "> How is it?\nI agree."),
        (9, 0, "user", "Hi Ann,\nthe build is broken\nsince monday"), (9, 1, "user", "> the build is broken\nwhere\n> since monday\nhm"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in chat.threads(frame(spark, rows)).collect()}
    assert (got[3, 0]["reply_conv"], got[3, 0]["reply_turn"]) == (7, 1) and got[3, 0]["text"] == "Me too." and got[3, 0]["thread_id"] == 3
    assert (got[3, 0]["n_quoted"], got[3, 0]["n_linked"]) == (2, 2)
    assert [got[k]["position"] for k in ((7, 0), (7, 1), (3, 0))] == [0, 1, 2]
    assert (got[9, 1]["reply_turn"], got[9, 1]["n_quoted"], got[9, 1]["n_linked"]) == (0, 2, 2)


def test_circles_are_opened(spark):
    rows = [(1, 0, "user", "> b two.\na one."), (2, 0, "user", "> c three.\nb two."), (3, 0, "user", "> a one.\nc three."), (4, 0, "user", "> c three.\nd.")]
    got = {r["conv_id"]: r for r in chat.threads(frame(spark, rows)).collect()}
    assert {k: r["reply_conv"] for k, r in got.items()} == {1: 2, 2: 3, 3: 1, 4: 3}
    # opened at 1: then 3 follows 1, and 2 and 4 follow 3
    assert [got[k]["position"] for k in (1, 3, 2, 4)] == [0, 1, 2, 3]


def test_long_and_deep_texts(spark):
    rows = [(1, 0, "user", ">" * 200_000), (1, 1, "user", "> " * 100_000 + "x"), (1, 2, "user", "\n" * 200_000), (1, 3, "user", "> a.\n" * 100_000), (1, 4, "user", "wrote " * 50_000 + ":"), (1, 5, "user", "\n".join(">" * i + " deep." for i in range(1, 400))), (1, 6, "user", "a.\n" * 100_000)]
    got = {r["turn"]: r for r in chat.threads(frame(spark, rows)).collect()}
    assert got[0]["levels"] == 200_000 and got[3]["n_quoted"] == 100_000 and got[5]["n_quoted"] == 399


class Plain:
    """Quotation linking in plain Python, over all messages at once."""

    def __init__(self, rows):
        self.rows = rows
        self.parsed = {}
        for c, t, _, text in rows:
            lines = []
            for line in (text or "").split("\n"):
                marks = re.match(r"[ \t>]*>[ \t]?", line)
                lines.append((marks[0].count(">") if marks else 0, line[marks.end() :] if marks else line))
            intro = [bool(re.search(chat.INTRODUCES, x)) and any(lv > n for lv in self.following(lines, i)) for i, (n, x) in enumerate(lines)]
            self.parsed[c, t] = (lines, intro)
        self.own = {k: "\n".join(x for (n, x), skip in zip(lines, intro, strict=True) if n == 0 and not skip).strip(" \t\r\n") for k, (lines, intro) in self.parsed.items()}

    @staticmethod
    def following(lines, i):
        out = [lines[i + 1][0]] if i + 1 < len(lines) else []
        return out + ([lines[i + 2][0]] if i + 2 < len(lines) and not lines[i + 1][1].strip(" ") else [])

    @staticmethod
    def flat(x):
        return re.sub(r"\s+", " ", x.lower()).strip(" ")

    def sentences(self, block):
        return [s.strip(" ") for s in re.split(r"(?<=[.!?])\s+", self.flat(block)) if s.strip(" ")]

    def passages(self, text):
        blocks = re.split(r"\n\s*\n", text)
        return {s for b in blocks for s in self.sentences(b)} | {self.flat(x) for x in text.split("\n")} | {self.flat(b) for b in blocks}

    def link(self):
        said = {}
        for k in sorted(self.own):
            for p in self.passages(self.own[k]):
                said.setdefault(p, []).append(k)
        out = {}
        for (c, t), (lines, intro) in self.parsed.items():
            def to(p, c=c, t=t):
                here = [k for k in said.get(p, []) if k[0] == c and k[1] < t]
                return next(iter(here or [k for k in said.get(p, []) if k[0] != c]), None)

            votes, quoted, linked = {}, 0, 0
            for level in {n for n, _ in lines if n > 0}:
                text = "\n".join(x if n == level and not skip else "" for (n, x), skip in zip(lines, intro, strict=True))
                for block in re.split(r"\n\s*\n", text):
                    own = self.sentences(block)
                    hits = [k for s in own if (k := to(s))]
                    quoted += len(own)
                    linked += len(hits)
                    if not hits:
                        hits = [k for x in dict.fromkeys(self.flat(x) for x in block.split("\n")) if x and x not in own and (k := to(x))]
                        linked += bool(hits)
                    for k in hits:
                        votes[k] = votes.get(k, 0) + (level == 1)
            best = max(((n, k) for k, n in votes.items() if n), default=(0, None))[1]
            out[c, t] = (best, quoted, linked)
        return out


def test_links_as_brute_force(spark):
    rng = random.Random(11)
    said = ["yes.", "the build is broken", "Hello there.", "see you", "why? because.", "A longer  line of text", "ok"]
    rows, texts = [], []
    for c in range(60):
        for t in range(rng.randrange(1, 5)):
            lines = []
            for _ in range(rng.randrange(1, 7)):
                kind = rng.random()
                if kind < 0.35 and texts:
                    lines += [">" * rng.randrange(1, 3) + rng.choice([" ", ""]) + x for x in rng.choice(texts).split("\n")[: rng.randrange(1, 4)]]
                elif kind < 0.45:
                    lines.append(rng.choice(["", "> X wrote:", "X wrote:"]))
                else:
                    lines.append(rng.choice(said) + rng.choice(["", f" {rng.randrange(30)}", f" {rng.randrange(30)}."]))
            text = "\n".join(lines)
            texts.append(text)
            rows.append((c, t, "user", text))
    rng.shuffle(rows)
    got = {(r["conv_id"], r["turn"]): ((r["reply_conv"], r["reply_turn"]) if r["reply_conv"] is not None else None, r["n_quoted"], r["n_linked"]) for r in chat.threads(frame(spark, rows)).collect()}
    want = Plain(rows).link()
    assert sum(1 for v in want.values() if v[0]) > 40
    assert got == want
