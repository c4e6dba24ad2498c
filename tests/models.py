"""Plain Python versions of the matchers, for comparison."""


def ordered(events, key):
    """Events (id, code, ts, ...) in buckets by ``key``, each in (ts, id) order."""
    out = {}
    for e in sorted((e for e in events if e[2] is not None), key=lambda e: (e[2], e[0])):
        k = key(e)
        if k is not None:
            out.setdefault(k, []).append(e)
    return out


def sequence(events, codes):
    found, chain = [], []
    for e in events:
        if e[1] == codes[len(chain)]:
            chain.append(e[0])
            if len(chain) == len(codes):
                found.append(tuple(chain))
                chain = []
    return found


def temporal(events, codes, within, total=0):
    n = len(codes)
    latest, found = [None] * n, []
    for e in events:
        done = None
        for s in reversed(range(n)):
            if codes[s] != e[1]:
                continue
            if s == 0:
                latest[0] = [e]
                continue
            before = latest[s - 1]
            if before and e[2] - before[-1][2] <= within and not (total and e[2] - before[0][2] > total):
                latest[s] = before + [e]
                if s == n - 1:
                    done = latest[s]
        if done:
            found.append(tuple(x[0] for x in done))
            latest = [None] * n
    return found
