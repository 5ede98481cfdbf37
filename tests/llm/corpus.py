"""Documents for the tests."""

import random


def corpus(seed=3, docs=60):
    """Random texts, copies, near copies, shared passages, short, empty and null texts, odd white space."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(70)
    rows = [(i, text(rnd.choice([3, 20, 60, 150, 400]))) for i in range(docs)]
    for i in range(docs, docs + 25):
        base = rows[rnd.randrange(docs)][1].split(" ")
        kind = i % 5
        if kind == 0:
            rows.append((i, " ".join(base)))
        elif kind == 1:
            for _ in range(max(1, len(base) // 60)):
                base[rnd.randrange(len(base))] = word()
            rows.append((i, "\n ".join(base)))
        elif kind == 2:
            rows.append((i, text(30) + " " + passage + "\t" + text(40)))
        elif kind == 3:
            rows.append((i, passage[: rnd.randint(300, 420)] + text(9)))
        else:
            rows.append((i, "  ".join(base).upper()))
    copy = text(120)
    rows += [(1000 + i, copy) for i in range(40)]
    rows += [(2000 + i, copy + f" {i}") for i in range(30)]
    rows += [(3000, ""), (3001, None), (3002, " \n\t"), (3003, "one two"), (3004, "One  two"), (3005, "ab " * 300),
             (3006, "x" * 900), (3007, "ab " * 300 + "c"), (3008, "a"), (3009, "a")]
    rows += [rows[0], rows[0], rows[5], (7, "another text of the same id"), (None, copy), (None, "alone " * 3)]
    return rows
