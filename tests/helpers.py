import os


def write(tmp_path, name: str, text: str) -> str:
    p = os.path.join(str(tmp_path), name)
    with open(p, "w") as f:
        f.write(text)
    return p


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("trace_id", "ordinal").collect()]
