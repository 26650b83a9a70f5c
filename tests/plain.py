"""Plain-Python statements of the order-dependent semantics, used only as test oracles."""


def iou(a, b):
    w = min(a[2], b[2]) - max(a[0], b[0])
    h = min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0, w) * max(0, h)
    if inter <= 0:
        return 0.0
    area = lambda r: max(0, r[2] - r[0]) * max(0, r[3] - r[1])
    union = area(a) + area(b) - inter
    return inter / union if union > 0 else 0.0


def track(frames, threshold, max_missed):
    """frames: list of lists of (label, box).  Returns {(frame, index): (track_id, hits)}."""
    live, next_id, out = {}, 1, {}
    for f, dets in enumerate(frames):
        pairs = sorted(
            (-iou(s["box"], box), tid, j)
            for tid, s in live.items()
            for j, (label, box) in enumerate(dets)
            if s["label"] == label and iou(s["box"], box) >= threshold
        )
        used, got = set(), {}
        for _, tid, j in pairs:
            if tid not in used and j not in got:
                used.add(tid)
                got[j] = tid
        for tid in [t for t in live if t not in used]:
            live[tid]["missed"] += 1
            if live[tid]["missed"] > max_missed:
                del live[tid]
        for j, (label, box) in enumerate(dets):
            tid = got.get(j)
            if tid is None:
                tid, next_id = next_id, next_id + 1
                live[tid] = {"label": label, "hits": 0}
            s = live[tid]
            s.update(box=box, missed=0, hits=s["hits"] + 1)
            out[(f, j)] = (tid, s["hits"])
    return out


def fuse(events, delta, min_sensors, match_label, threshold):
    """events: dicts with t, sensor, id, run, type, label, box.  Returns list of member-id lists."""
    ev = sorted(events, key=lambda e: (e["t"], e["sensor"], e["id"], e["run"]))
    used, out = set(), []
    for i, a in enumerate(ev):
        if i in used:
            continue
        cand = []
        for j, c in enumerate(ev):
            if j == i or j in used or c["sensor"] == a["sensor"] or c["type"] != a["type"]:
                continue
            if abs(a["t"] - c["t"]) > delta or (match_label and a["label"] != c["label"]):
                continue
            both = a["box"] is not None and c["box"] is not None
            if threshold is not None and (not both or iou(a["box"], c["box"]) < threshold):
                continue
            cand.append((abs(a["t"] - c["t"]), -(iou(a["box"], c["box"]) if both else -1.0), j))
        group, sensors = [i], {a["sensor"]}
        for _, _, j in sorted(cand):
            if ev[j]["sensor"] not in sensors:
                sensors.add(ev[j]["sensor"])
                group.append(j)
        if len(sensors) >= min_sensors:
            used.update(group)
            out.append([ev[k]["id"] for k in group])
    return out


def match(preds, gts, threshold):
    """preds: (index, confidence, box); gts: (index, box) of one frame and class."""
    free, rows = {g[0]: g[1] for g in gts}, []
    for index, _, box in sorted(preds, key=lambda p: (-p[1], p[0])):
        best, value = None, 0.0
        for g in sorted(free):
            v = iou(box, free[g])
            if v > value:
                best, value = g, v
        hit = best is not None and value >= threshold
        rows.append(("TP" if hit else "FP", index, best, value))
        if hit:
            del free[best]
    return rows + [("FN", None, g, None) for g in sorted(free)]
