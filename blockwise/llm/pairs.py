"""Broken prompt and response pairs: a multi-label linear classifier trained on synthetic defects."""

from __future__ import annotations

import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFECTS = ["empty", "truncated", "refusal", "copied", "other_language"]
#: Hash space of the n-grams; responses in the labelled sample (documented bound of the training data).
BUCKETS, SAMPLE = 1 << 15, 1000
# Frequent words from which training text of other languages is made.
FOREIGN_WORDS = {
    "en": "the of and to is that for it as was with be by on not at are this have from which there their has when who will more can only other some than mainly over",
    "de": "der die das und ist nicht ein eine den dem des von zu mit auf für im auch es aus sich wird haben wir ihr ohne aber wenn nach bei noch über oder diese ich sie vor allem ab",
    "es": "el la los las de que y en un una es no se por con para su al lo como más pero sus este porque esta entre cuando muy sin sobre desde todo del años",
    "fr": "le la les de des et en un une est que qui dans pour pas sur au par plus ne se ce il elle on avec son sa ses mais ou nous vous leur du sans cette depuis surtout",
    "it": "il lo la i gli di che e è per un una in non con del della sono come anche più nel alla dei delle si da questo questa dal anni",
    "pt": "o os a as um uma de do da dos das em no na não por com para ao que e se mais como mas foi seu sua pelo pela este esta anos",
    "nl": "het een van en is dat die de niet op te zijn met voor aan er om dan ook maar bij uit naar heeft deze dit door over jaren",
}
# Parts from which training refusals are put together, in general wording.
_REFUSE = {
    "en": (
        ["", "Sorry,", "I'm sorry, but", "My apologies,", "I'm afraid", "Thanks for your message, but", "I understand what you want, but", "As an AI model,", "To be clear,", "Regrettably,", "Hello,", "After looking at this,", "That is a sensitive matter, so", "I have thought about it, and", "Given my guidelines,"],
        ["I can't help with", "I cannot assist with", "I'm unable to provide", "I am not able to give you", "I won't do", "I will not take part in", "I'm not going to answer", "I'd rather not engage with", "I have to say no to", "I must refuse", "I'm not permitted to handle", "it isn't appropriate for me to do", "I don't feel able to complete", "I can't in good conscience carry out", "my policy doesn't let me do", "it's not right for me to attempt", "I have chosen not to respond to", "there is nothing I can offer on", "I would prefer to stay out of", "I do not answer", "I am declining", "it is impossible for me to fulfil", "I lack the permission for", "I refuse to work on"],
        ["that", "this", "your request", "this task", "such a question", "what you are asking", "this kind of analysis", "that information", "a description of {n}", "anything about {n}", "an evaluation of people", "the job described above", "the output you want", "this conversation"],
        [".", ".", ".", ". Is there something else you need?", ". Please turn to a qualified expert.", ". I hope that is all right.", ", because it may harm someone.", ", since it touches on confidential data.", ". Sorry about that.", "; kindly look for another way.", ". Someone else should judge this.", ". Thank you for understanding."],
    ),
    "de": (
        ["", "Leider", "Tut mir leid,", "Entschuldigung,", "Danke für die Anfrage, aber", "Ich verstehe den Wunsch, doch", "Als Sprachmodell", "Nach Prüfung:", "Bedauerlicherweise", "Das ist heikel, daher"],
        ["kann ich nicht helfen bei", "bin ich nicht befugt zu", "möchte ich nichts beitragen zu", "muss ich absagen bei", "darf ich nicht mitwirken an", "verzichte ich auf", "werde ich nicht antworten auf", "sehe ich mich außerstande zu", "verweigere ich die Mitarbeit an", "gebe ich keine Antwort auf", "ist es mir unmöglich, etwas zu sagen über", "lehne ich es ab, zu sprechen über"],
        ["dieser Anfrage", "dieser Frage", "dieser Aufgabe", "solchen Angaben", "{n}", "dem Gewünschten", "dieser Auswertung", "fremden Menschen"],
        [".", ".", ". Kann ich sonst etwas tun?", ". Bitte wenden Sie sich an Fachleute.", ", weil es jemandem schaden könnte.", ". Vielen Dank für Ihr Verständnis.", ". Das sollte jemand anders beurteilen."],
    ),
}
_EMPTY = [None, "", " ", "\n\n", "\t \n", '""', "{}", "[]", "null", "```\n\n```", "```json\n```", "```json\n{}\n```", '{"assignments":{},"labels":{}}', '{"labels":{},"assignments":{}}', '{"assignments": {}}', "...", "-", "''", '{"assignments":{},"labels":{}}\n', '```json\n{"assignments":{},"labels":{}}\n```']
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_RECORD = re.compile(r"\[record_index\s+(\d+)\]")
_KEYS = {"assignments", "labels", "json"}
#: Pairs taken as sound are left out from this share of a threshold on.
DOUBT = 0.5
#: Words of a run that counts as taken from the prompt.
WIDTH = 6
#: Upper ends of the bins of a share.
_BINS = (0.0, 0.15, 0.35, 0.55, 0.8, 1.0)
#: Dense features: pair features first, then those computed from n-grams (from N_PAIR on).
N_PAIR, N_NOVEL = 30, 24
DENSE = N_PAIR + N_NOVEL


def parse_answer(content: str) -> tuple[dict | None, str, bool]:
    """(first JSON object or None, the prose around it or all text, whether a JSON object was begun and not ended)."""
    i = content.find("{")
    if i < 0:
        return None, content, False
    try:
        obj, end = json.JSONDecoder(strict=False).raw_decode(content, i)
        return (obj if isinstance(obj, dict) else None), content[:i] + " " + content[end:], False
    except ValueError:
        return None, content, True
    except RecursionError:
        return None, content, False


def _answer_behind(content: str) -> tuple[dict, str, bool] | None:
    """The first JSON object with assignments at any brace, as ``parse_answer`` gives it, where prose holds other braces."""
    for m in re.finditer(r"\{(?=\s*\")", content):
        try:
            obj, end = json.JSONDecoder(strict=False).raw_decode(content, m.start())
        except (ValueError, RecursionError):
            continue
        if isinstance(obj.get("assignments"), dict):
            return obj, content[: m.start()] + " " + content[end:], False
    return None


def _texts(x) -> list[str]:
    if isinstance(x, str):
        return [x]
    if isinstance(x, dict):
        return [t for v in x.values() for t in _texts(v)]
    if isinstance(x, list):
        return [t for v in x for t in _texts(v)]
    return []


def _binned(share: float) -> int:
    return next(i for i, end in enumerate(_BINS) if share <= end + 1e-9)


class Pair:
    """What the classifier sees of one prompt and response: pair features and n-grams, both read whole."""

    __slots__ = ("x", "pairs", "words", "grams", "lang", "hashed", "asked")

    def __init__(self, prompt: str | None, lang: str | None, task: str | None, content: str | None, finish: str | None, assignments: list | dict | None = None):
        """``assignments`` holds the records of the parsed map; it is used where the content does not parse at its first brace."""
        prompt, content = prompt or "", content or ""
        self.lang = (lang or "en").lower()[:2]
        obj, around, cut = parse_answer(content)
        low = content.lower()
        words = _WORD.findall(low)
        said = [w for w in words if w not in _KEYS and not w.isdigit()]
        prompt_words = _WORD.findall(prompt.lower())
        in_prompt = self.asked = set(prompt_words)
        records = {int(m) for m in _RECORD.findall(prompt)}
        assigned: set[int] = set()
        got = obj.get("assignments") if obj else None
        if assignments and not isinstance(got, dict):
            obj, around, cut = _answer_behind(content) or (obj, around, cut)
            got = obj["assignments"] if obj and isinstance(obj.get("assignments"), dict) else dict.fromkeys(assignments)
            if cut and records and records <= {int(k) for k in got if str(k).strip().isdigit()}:
                cut = content.rstrip().rstrip("`").rstrip()[-1:] != "}"  # complete in the map and closed in the text
        grouped = isinstance(got, dict)
        if grouped:
            assigned = {int(k) for k in got if str(k).strip().isdigit()}
        is_assign = task == "assign" or (task is None and "assignments" in low)
        x = self.x = np.zeros(DENSE)
        x[0] = 1.0
        x[1] = not said and not assigned and not cut
        x[2], x[3] = is_assign, not is_assign
        x[4] = is_assign and not grouped and not cut and bool(said)
        x[5] = is_assign and grouped and bool(records) and records <= assigned
        x[6] = len(records - assigned) / len(records) if grouped and records and assigned else 0.0
        x[7] = x[6] > 0
        x[8] = cut and ("assignments" in low or "labels" in low)
        tail = content.rstrip().rstrip("`").rstrip()
        x[9] = bool(said) and not (bool(tail) and tail[-1] in ".!?。！？…}\"'”)]")
        x[10] = x[9] and not is_assign
        x[11] = (finish or "") in ("length", "max_tokens")
        x[12] = finish == "content_filter"
        known = {tuple(prompt_words[i : i + WIDTH]) for i in range(len(prompt_words) - WIDTH + 1)}
        covered = np.zeros(len(words), bool)
        for i in range(len(words) - WIDTH + 1):
            if tuple(words[i : i + WIDTH]) in known:
                covered[i : i + WIDTH] = True
        copied = float(covered.mean()) if len(words) >= WIDTH else 0.0
        x[13] = copied
        x[14 + _binned(copied)] = 1.0
        x[20] = "[record_index" in low
        head = _WORD.findall(prompt.lower().split("[record_index")[0])
        heads = {tuple(head[i : i + WIDTH]) for i in range(len(head) - WIDTH + 1)}
        x[21] = any(tuple(words[i : i + WIDTH]) in heads for i in range(len(words) - WIDTH + 1))
        x[22] = bool(obj) and not grouped and bool(said) and is_assign
        x[23] = bool(obj) and not grouped and bool(said) and not is_assign
        prose = [*_texts(obj.get("labels", obj)), around] if obj else [around]
        text = " ".join(prose)
        spoken = [w for w in _WORD.findall(text.lower()) if w not in _KEYS and not w.isdigit()]
        x[24] = min(1.0, len(spoken) / 60)
        x[25] = sum(w in in_prompt for w in spoken) / len(spoken) if spoken else 0.0
        letters = [c for c in text if c.isalpha()]
        x[26] = sum(ord(c) > 0x24F for c in letters) / max(1, len(letters))
        x[27] = x[26] > 0.2
        x[28] = x[24] * x[3]
        x[29] = bool(around.strip(" \n\t`")) and bool(obj)
        self.words = [w for w in spoken if w not in in_prompt or len(w) < 4]
        mask = ["<p>" if w in in_prompt and len(w) > 3 else ("<n>" if any(c.isdigit() for c in w) else w) for w in _WORD.findall(text.lower()) if w not in _KEYS]
        self.pairs = [f"{a} {b}" for a, b in zip(["<s>", *mask], [*mask, "</s>"])] if mask else []
        tri = [f"^{w}$"[i : i + 3] for w in self.words if not w[0].isdigit() for i in range(len(w))]
        self.grams = tri
        kind = "a" if is_assign else "p"
        hashed = {zlib.crc32(g.encode()) % BUCKETS for g in [*(f"{self.lang} {w}" for w in self.words), *(f"{kind} {p}" for p in self.pairs), *(f"{self.lang}{t}" for t in tri)]}
        self.hashed = np.fromiter(sorted(hashed), np.int64, len(hashed))

    def against(self, usual: dict) -> np.ndarray:
        """The features with the shares of word pairs, letter triples and words that are not usual in this language."""
        x = self.x.copy()
        for at, (have, of) in zip((N_PAIR, N_PAIR + 8, N_PAIR + 16), ((self.pairs, usual["pairs"]), (self.grams, usual["grams"]), (self.words, usual["words"]))):
            known = of.get(self.lang, frozenset())
            if have and known:
                share = sum(g not in known for g in have) / (len(have) + 3)  # three known ones in advance: short answers prove little
                x[at] = share
                x[at + 1 + _binned(share)] = 1.0
                x[at + 7] = share * self.x[3]
        return x


def usual_answers(pairs: list[Pair], share: float, least: int) -> dict:
    """What at least ``share`` of the sound answers of a language hold (``least`` at least): word pairs, letter triples, and words, these also of prompts."""
    seen: dict[str, dict[str, dict[str, int]]] = {"pairs": {}, "grams": {}, "words": {}}
    size: dict[str, int] = {}
    for p in pairs:
        size[p.lang] = size.get(p.lang, 0) + 1
        for kind, held in (("pairs", set(p.pairs)), ("grams", set(p.grams)), ("words", p.asked.union(p.words))):
            counts = seen[kind].setdefault(p.lang, {})
            for g in held:
                counts[g] = counts.get(g, 0) + 1
    return {kind: {lang: frozenset(g for g, n in counts.items() if n >= max(least, math.ceil(share * size[lang]))) for lang, counts in langs.items()} for kind, langs in seen.items()}


# ---------------------------------------------------------------- synthetic defects


def _foreign(rng: random.Random, own: str, prompt_words: list[str]) -> str:
    """Sentences of another language: its frequent words among words of the prompt."""
    kind = rng.choice([k for k in FOREIGN_WORDS if k != own] + ["zh", "ru"])
    if kind == "zh":
        return "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(rng.randint(8, 40))) + "。"
    if kind == "ru":
        return " ".join("".join(chr(rng.randrange(0x430, 0x450)) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(5, 25))) + "."
    words = FOREIGN_WORDS[kind].split()
    out = []
    for _ in range(rng.randint(1, 4)):
        s = []
        for _ in range(rng.randint(4, 14)):
            s.append(rng.choice(prompt_words) if rng.random() < 0.3 and prompt_words else rng.choice(words))
        out.append(" ".join(s).capitalize() + ".")
    return " ".join(out)


def _refusal(rng: random.Random, own: str, name: str, head: list[str], held: bool) -> str:
    """A refusal put together from parts, or with some words of the prompt's instruction as what is refused.

    Every fifth part is used in held-out refusals only, which use no other.
    """
    pick = lambda parts: rng.choice([p for i, p in enumerate(parts) if (i % 5 == 1) == held])
    opening, cannot, what, close = _REFUSE.get(own, _REFUSE["en"])

    def said() -> str:
        if len(head) > 6 and rng.random() < 0.4:
            at = rng.randrange(len(head) - 3)
            return " ".join(head[at : at + rng.randint(2, 5)])
        return pick(what).replace("{n}", name)

    t = f"{pick(opening)} {pick(cannot)} {said()}{rng.choice(close)}".strip()
    if rng.random() < 0.3:
        t += " " + f"{pick(opening)} {pick(cannot)} {said()}.".strip()
    t = t[:1].upper() + t[1:]
    if rng.random() < 0.15:
        t = json.dumps({rng.choice(["message", "error", "reason", "note"]): t} | ({"status": rng.choice(["declined", "refused", "error"])} if rng.random() < 0.4 else {}), ensure_ascii=False)
    return t


def held_out(response_id) -> bool:
    return zlib.crc32(str(response_id).encode()) % 5 == 0


def synthesize(rows: list[dict], seed: int = 7) -> list[tuple[dict, int]]:
    """(pair, label) with labels 0 (no defect) or 1 + index of the defect, made from pairs taken as sound.

    Answers are emptied, cut, stripped of records, replaced by parts of the prompt, by refusals, by answers to prompts
    of another language (swapped) and by made text of another language.
    """
    rng = random.Random(seed)
    out: list[tuple[dict, int]] = []
    by_lang: dict[tuple, list[str]] = {}
    of_lang: dict[str, int] = {}
    for r in rows:
        own = (r["prompt_lang"] or "en").lower()[:2]
        by_lang.setdefault((r["task"], own), []).append(r["content"])
        of_lang[own] = of_lang.get(own, 0) + 1
    for r in rows:
        own = (r["prompt_lang"] or "en").lower()[:2]
        c, p = r["content"], r["prompt"]
        name = r.get("name") or "this author"
        made = lambda text, label, finish=None: out.append((r | {"content": text, "finish_reason": finish if finish is not None else r["finish_reason"], "assignments": None}, 1 + DEFECTS.index(label)))
        out.append((r, 0))
        if rng.random() < 0.4:
            made(rng.choice(_EMPTY), "empty")
        lose = rng.choice(["length", "max_tokens", "stop", "stop", "end_turn"])
        if len(c) > 12:
            at = rng.randint(max(4, len(c) // 10), len(c) - 2)
            piece = c[:at]
            if "{" in piece or r["task"] != "assign":
                if piece.rstrip() and piece.rstrip()[-1] not in ".!?}`":
                    made(piece, "truncated", lose)
        obj, _, _ = parse_answer(c)
        if obj and isinstance(obj.get("assignments"), dict) and len(obj["assignments"]) > 1:
            keys = list(obj["assignments"])
            keep = keys[: rng.randint(1, len(keys) - 1)]
            made(json.dumps(obj | {"assignments": {k: obj["assignments"][k] for k in keep}}), "truncated", lose if rng.random() < 0.3 else None)
        head = p.split("[record_index")[0].split()
        for _ in range(min(6, max(1, round(150 / of_lang[own])))):
            made(_refusal(rng, own, name, head, held_out(r["response_id"])), "refusal", "content_filter" if rng.random() < 0.1 else None)
        lines = [x for x in p.splitlines() if x.strip()]
        kind = rng.randrange(5)
        text = p if kind == 0 else lines[0] if kind == 1 and lines else "\n".join(lines[: rng.randint(1, len(lines))]) if kind == 2 else p[p.find("[record_index") :] if kind == 3 else "\n".join(lines[(s := rng.randrange(len(lines))) : s + rng.randint(2, 12)])
        if rng.random() < 0.25:
            text = text.upper()
        if rng.random() < 0.25:
            text = rng.choice(["Sure, here it is.\n\n", "Here you go:\n", "Answer: ", "> "]) + text
        if len(_WORD.findall(text)) >= 8:
            made(text, "copied")
        words = [w for w in _WORD.findall(p) if len(w) > 4][:200]
        others = [t for (task, lang), ts in by_lang.items() if task == r["task"] and lang != own for t in ts]
        if obj and isinstance(obj.get("labels"), dict) and obj["labels"]:
            made(json.dumps(obj | {"labels": {k: _foreign(rng, own, words).split(". ")[0] for k in obj["labels"]}}, ensure_ascii=False), "other_language")
            if rng.random() < 0.4:
                made(_foreign(rng, own, words), "other_language")
        elif r["task"] != "assign":
            made(rng.choice(others) if others and rng.random() < 0.4 else _foreign(rng, own, words), "other_language")
    return out


# ---------------------------------------------------------------- classifier


class Sparse:
    def __init__(self, dense: np.ndarray, grams: list[np.ndarray]):
        self.dense = dense
        self.rows = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        self.cols = np.concatenate(grams) if grams else np.zeros(0, np.int64)
        self.vals = 1.0 / np.sqrt(np.maximum(1, np.repeat([len(g) for g in grams], [len(g) for g in grams])))

    def dot(self, wd: np.ndarray, ws: np.ndarray) -> np.ndarray:
        return self.dense @ wd + np.stack([np.bincount(self.rows, self.vals * ws[self.cols, k], len(self.dense)) for k in range(ws.shape[1])], 1)

    def t_dot(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.dense.T @ g, np.stack([np.bincount(self.cols, self.vals * g[self.rows, k], BUCKETS) for k in range(g.shape[1])], 1)


def fit(x: Sparse, y: np.ndarray, weight: np.ndarray, rounds: int, l2: float = 2e-4, rate: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """Weights of one logistic model per defect (multi-label), by Adam on the whole sample."""
    wd, ws = np.zeros((DENSE, y.shape[1])), np.zeros((BUCKETS, y.shape[1]))
    state = [np.zeros_like(wd), np.zeros_like(wd), np.zeros_like(ws), np.zeros_like(ws)]
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(wd, ws), -30, 30)))
        gd, gs = x.t_dot((p - y) * weight[:, None] / weight.sum())
        for w, g, i in ((wd, gd + l2 * wd, 0), (ws, gs + l2 * ws, 2)):
            state[i] = 0.9 * state[i] + 0.1 * g
            state[i + 1] = 0.999 * state[i + 1] + 0.001 * g * g
            w -= rate * (state[i] / (1 - 0.9**t)) / (np.sqrt(state[i + 1] / (1 - 0.999**t)) + 1e-8)
    return wd, ws


def _sound(p: Pair) -> bool:
    """A pair without any defect that shows in its form, from which defects are made; refusals pass here."""
    x = p.x
    if x[1] or x[7] or x[8] or x[9] or x[11] or x[12] or x[13] > 0.5 or x[20] or x[21] or x[22] or x[23] or x[27]:
        return False
    return bool(x[5]) or not x[2]


def _pair(r: dict) -> Pair:
    return Pair(r["prompt"], r["prompt_lang"], r["task"], r["content"], r["finish_reason"], r.get("assignments"))


def _odds(model: dict, x: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    z = x @ model["wd"]
    if len(hashed):
        z = z + model["ws"][hashed].sum(0) / math.sqrt(len(hashed))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _verdict(model: dict, p: np.ndarray) -> str | None:
    """The defect with the most room above its threshold; below all of them the nearest one, if the pair is surely not sound."""
    over = (p[:-1] - model["threshold"]) / (1 - model["threshold"] + 1e-9)
    k = int(np.argmax(over))
    return DEFECTS[k] if over[k] >= 0 or p[-1] < model["sound"] else None


def train(rows: list[dict], seed: int = 7) -> dict:
    """Model from a bounded sample of pairs: sound ones are kept, broken in every way and fitted.

    What the first model finds among the pairs taken as sound (refusals and other languages show in no form) is left
    out and the model fitted again. Thresholds per defect are those with the best F1 on a fifth of the pairs, which is
    held out; its refusals are made of parts that no training refusal has. One more model tells sound pairs; a pair that
    it gives less than half of what 99.5 percent of the held-out sound pairs get is surely not sound.
    """
    rows = sorted((r for r in rows if r["content"] and r["prompt"] and _sound(_pair(r))), key=lambda r: r["response_id"])
    if len(rows) < 5:
        return {"wd": np.zeros((DENSE, len(DEFECTS) + 1)), "ws": np.zeros((BUCKETS, len(DEFECTS) + 1)), "threshold": np.ones(len(DEFECTS)), "sound": 0.0, "usual": {"pairs": {}, "grams": {}, "words": {}}, "held_out_f1": None}
    made = synthesize(rows, seed)
    views = [_pair(r) for r, _ in made]
    label = np.array([k for _, k in made])
    ids = np.array([r["response_id"] for r, _ in made])
    held = np.array([held_out(i) for i in ids])
    model: dict = {}
    use = np.ones(len(made), bool)
    for trust, share, least, rounds in ((1.0, 0.03, 5, 60), (3.0, 0.01, 3, 200)):  # the first model learns from pairs of which some are defective
        usual = usual_answers([v for v, k, u in zip(views, label, use) if u and not k], share, least)
        dense = np.stack([v.against(usual) for v in views])
        y = np.zeros((len(made), len(DEFECTS) + 1))
        y[np.arange(len(made)), label - 1] = 1.0  # the last column is that of sound pairs
        weight = np.where(label > 0, 1.0, trust)
        part = lambda m: Sparse(dense[m], [views[i].hashed for i in m])
        fitted, rest = np.flatnonzero(use & ~held), np.flatnonzero(use & held)
        wd, ws = fit(part(fitted), y[fitted], weight[fitted], rounds)
        p = 1 / (1 + np.exp(-np.clip(part(rest).dot(wd, ws), -30, 30)))
        threshold, f1 = np.full(len(DEFECTS), 0.5), {}
        for k, d in enumerate(DEFECTS):
            best = 0.0
            for t in np.arange(0.3, 0.91, 0.05):
                tp = ((p[:, k] >= t) & (y[rest, k] == 1)).sum()
                score = 2 * tp / max(1, (p[:, k] >= t).sum() + (y[rest, k] == 1).sum())
                if score > best + 1e-9 or (score > best - 1e-9 and abs(t - 0.5) < abs(threshold[k] - 0.5)):
                    best, threshold[k] = max(best, score), t
            f1[d] = round(float(best), 4)
        good = p[label[rest] == 0, -1]
        model = {"wd": wd, "ws": ws, "threshold": threshold, "sound": 0.5 * float(np.quantile(good, 0.005)) if len(good) else 0.0, "usual": usual, "held_out_f1": f1}
        dirty = {i for i, v, k, x in zip(ids, views, label, dense) if not k and (_odds(model, x, v.hashed)[:-1] > DOUBT * threshold).any()}
        use = ~np.isin(ids, list(dirty))
    return model


def classify(model: dict, r: dict) -> str | None:
    """The defect of one pair, or None: among those above their threshold the one with the most room used."""
    v = _pair(r)
    return _verdict(model, _odds(model, v.against(model["usual"]), v.hashed))


def without_ngrams(model: dict) -> dict:
    """The model with the weights of everything that is computed from n-grams set to zero (for the ablation)."""
    wd = model["wd"].copy()
    wd[N_PAIR:] = 0.0
    return model | {"wd": wd, "ws": np.zeros_like(model["ws"])}


def broken_pairs(responses: DataFrame, requests: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(response_id, defect) for every response that does not properly answer the prompt of its request.

    The model is trained on the driver from at most ``sample`` responses (those with the least hash of their id) and
    their prompts; its size is fixed. All responses are then classified in Arrow batches after one equi join on
    request_id; those without a request_id do not enter the join. Repeated rows count once; of several versions of a
    request the one created last counts; a null id gives no row; a response whose request is unknown or has a null
    prompt is judged by its own text; null content is empty. With fewer than five sound pairs nothing can be learnt and
    no row is reported.
    """
    # of the parsed map only the records count; a map itself cannot be told from a repeated one
    assigned = F.array_sort(F.map_keys("assignments")).alias("assignments")
    fields = ["response_id", "request_id", "content", "finish_reason", assigned]
    res = responses.where("response_id is not null").select(*fields)
    # rows are told apart by a hash of their whole content, so that no text is a shuffle key
    res = res.groupBy("response_id", "request_id", F.xxhash64("content", "finish_reason", "assignments").alias("h")).agg(F.first("content").alias("content"), F.first("finish_reason").alias("finish_reason"), F.first("assignments").alias("assignments")).drop("h")
    parts = ["task", "prompt_lang", "prompt", "name"]
    order = [c for c in ("created_at",) if c in requests.columns]
    req = requests.where("request_id is not null").groupBy("request_id").agg(F.max(F.struct(*order, *parts)).alias("r")).select("request_id", *[F.col(f"r.{c}").alias(c) for c in parts])
    chosen = res.select("response_id", "request_id", F.xxhash64("response_id").alias("h")).distinct().orderBy("h", "response_id", "request_id").limit(sample)
    some = F.broadcast(chosen.select("response_id").distinct())  # at most `sample` ids
    wanted = F.broadcast(chosen.select("request_id").where("request_id is not null").distinct())
    left = res.join(some, "response_id", "left_semi")
    right = req.join(wanted, "request_id", "left_semi")
    model = train([r.asDict() for r in left.join(right, "request_id").collect()])
    columns = ["response_id", "content", "finish_reason", "assignments", *parts]
    alone = res.where("request_id is null").select("response_id", "content", "finish_reason", "assignments", *[F.lit(None).cast("string").alias(c) for c in parts])
    joined = res.where("request_id is not null").join(req, "request_id", "left").select(*columns).unionByName(alone)
    shared = joined.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            ids, found = [], []
            for r in b.to_pylist():
                d = classify(m, r)
                if d is not None:
                    ids.append(r["response_id"])
                    found.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=["response_id", "defect"])

    return joined.withColumn("response_id", F.col("response_id").cast("long")).drop("name").mapInArrow(run, "response_id long, defect string").distinct()
