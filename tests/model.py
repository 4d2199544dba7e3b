"""Plain Python model of the nested-path semantics that the operators are compared with."""


def values(record, path):
    """All values at a dotted path; lists of records fan out, a list at the end is one value."""
    found = [record]
    parts = path.split(".")
    for k, name in enumerate(parts):
        nxt = []
        for r in found:
            if isinstance(r, dict) and name in r:
                v = r[name]
                if k < len(parts) - 1 and isinstance(v, list):
                    nxt += [x for x in v if x is not None]
                elif k == len(parts) - 1 or v is not None:
                    nxt.append(v)
        found = nxt
    return found


def leaf_rows(record, prefix=""):
    for k, v in record.items():
        if k == "_id":
            continue
        if isinstance(v, dict):
            yield from leaf_rows(v, f"{prefix}{k}.")
        elif isinstance(v, list):
            for x in v:
                if isinstance(x, dict):
                    yield from leaf_rows(x, f"{prefix}{k}.")
        else:
            yield prefix + k, None if v is None else str(v)
