import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, kinds=4000):
    return " ".join("w%d" % rng.randrange(kinds) for _ in range(n))


def by_id(df, column):
    return {r["doc_id"]: r[column] for r in df.collect()}
