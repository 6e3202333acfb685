"""Plain-numpy side of the tests: small matrices to sample tables."""

import numpy as np
import pandas as pd


def samples(spark, data: np.ndarray, names, rid="r"):
    channels, n = data.shape
    frame = pd.DataFrame({
        "recording_id": rid, "channel": np.repeat(names, n), "ch_index": np.repeat(np.arange(channels), n).astype("int32"),
        "i": np.tile(np.arange(n), channels), "v": data.ravel(),
    })
    return spark.createDataFrame(frame, "recording_id string, channel string, ch_index int, i bigint, v double")


def event(spark, time_s, rid="r", label="event", duration=2.0):
    return spark.createDataFrame([(rid, time_s, label, duration)], "recording_id string, time_s double, label string, duration_s double")


def detector_by_hand(data, sfreq, window_s, step_s, fraction, mad, gap, involved):
    """The whole blind detector on one matrix; (start, end, peak, channels) of every event."""
    w, s = round(window_s * sfreq), round(step_s * sfreq)
    starts = range(0, data.shape[1] - w + 1, s)
    x = np.arange(w)
    feats = []
    for a in starts:
        chunk = data[:, a : a + w]
        chunk = np.array([row - np.polyval(np.polyfit(x, row, 1), x) for row in chunk])
        d = np.diff(chunk, axis=1)
        feats.append(np.stack([np.sqrt((chunk**2).mean(1)), np.ptp(chunk, 1), np.abs(d).mean(1), np.sqrt((d**2).mean(1))], 1))
    feats = np.array(feats)
    center = np.median(feats, 0)
    scale = 1.4826 * np.median(np.abs(feats - center), 0)
    z = np.clip((feats - center) / scale, 0, 25)
    channel = np.sort(z, 2)[:, :, -2:].mean(2)
    keep = max(1, int(np.ceil(data.shape[0] * fraction)))
    score = np.sort(channel, 1)[:, -keep:].mean(1)
    c = np.median(score)
    k = 1.4826 * np.median(np.abs(score - c))
    limit = c + mad * k
    hits = np.flatnonzero(score >= limit)
    runs = []
    for h in hits:
        if runs and (h - runs[-1][-1]) * s / sfreq <= window_s + gap:
            runs[-1].append(h)
        else:
            runs.append([h])
    out = []
    for run in runs:
        peak = run[int(np.argmax(score[run]))]
        names = [f"C{j}" for j in np.flatnonzero(channel[peak] >= max(3.0, limit))]
        if len(names) >= involved:
            out.append((run[0] * s / sfreq, run[-1] * s / sfreq + window_s, peak * s / sfreq, names, score[peak]))
    return sorted(out, key=lambda e: -e[4])
