"""Main-text extraction: a bidirectional LSTM labels every leaf block of a page."""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexgraph.llm.common import hashed_words
from lexgraph.session import ensure_importable

PATH_DIM, WORD_DIM, NUM_DIM, HIDDEN = 512, 256, 22, 24
#: Elements nest so deep at most (as in browsers), and so many of the nearest ancestors are looked at.
DEEPEST, NEAREST = 512, 32
_UNSEEN = r"""<!--(?:.*?-->|.*\Z)|<(script|style|template|noscript|svg|iframe|textarea|select|title)\b[^>]*+>(?:.*?</\1\s*>|.*\Z)"""
_PIECE = re.compile(_UNSEEN + r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(?P<broken><[a-zA-Z/][^>]*+>)|<[!?][^>]*+>|[^<]++|<""", re.S | re.I)
#: The same without quotes, for what follows a quote that never ends.
_LOOSE = re.compile(_UNSEEN + r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<rest>[^>]*+)>|<[a-zA-Z/!?][^>]*+>|[^<]++|<""", re.S | re.I)
_OPEN = re.compile(r"<[a-zA-Z/!?]")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME = re.compile(r"[^a-z0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em embed font i img ins kbd label link mark meta q rp rt ruby s samp small span strike strong sub sup time tt u var wbr del input".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = frozenset("ul ol dl table article section div body aside nav main".split())


def _push(stack: list[tuple], tag: str, rest: str) -> None:
    names = [tag]
    if rest and "=" in rest:
        for kind, a, b, c in _ATTR.findall(rest):
            names += [f".{x}" for x in _NAME.split((a or b or c).lower()) if x]
    stack.append((tag, tuple(names)))


def _pieces(page: str) -> Iterator[re.Match]:
    """Text, tags and unseen elements of ``page``, in time linear in its length.

    An open tag at the page's end is dropped. After a quote that never ends, tags
    end at the next > whatever the quotes.
    """
    end = page.rfind(">") + 1
    for m in _PIECE.finditer(page, 0, end):
        if m["broken"]:
            yield from _LOOSE.finditer(page, m.start(), end)
            break
        yield m
    tail = _OPEN.search(page, end)
    yield from re.compile(r".+", re.S).finditer(page, end, tail.start() if tail else len(page))


def leaf_blocks(page: str) -> list[tuple[str, tuple, int]]:
    """(text, path, characters inside links) of every non-empty leaf block, in page order.

    Comments, scripts, styles and other unseen elements are left out. A block
    ends where a block-level element starts or ends; character references are
    decoded, white space becomes one space, and ends are trimmed. Tag soup is
    taken as browsers do: a new block closes an open paragraph, and an end tag
    without a start is ignored. ``path`` has the names of the NEAREST ancestors.
    Elements nest DEEPEST deep at most: beyond, a start tag is not kept, while its
    end tag may close an outer element of that name, and what follows loses it early.
    """
    out: list[tuple[str, tuple, int]] = []
    stack: list[tuple] = []
    parts: list[str] = []
    links = anchors = heads = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text and not heads:
                out.append((text, tuple(n for _, n in stack[-NEAREST:]), links))
            parts.clear()
        links = 0

    def pop_to(k: int) -> None:
        nonlocal anchors, heads
        anchors -= sum(t == "a" for t, _ in stack[k:])
        heads -= sum(t == "head" for t, _ in stack[k:])
        del stack[k:]

    for m in _pieces(page):
        found = m.groupdict()
        tag = found.get("tag")
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                parts.append(piece)
                if anchors:
                    links += len(piece)
            continue
        tag = tag.lower()
        block = tag not in _INLINE
        if m["close"]:
            if block:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if not block and stack[k][0] not in _INLINE:
                    break
            continue
        if tag == "br":
            parts.append(" ")
        if block:
            flush()
            if tag in ("body", "p", "div", "article", "main", "nav", "header") and stack and stack[-1][0] == "head":
                pop_to(len(stack) - 1)
            closes = _CLOSES.get(tag, {"p"})
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes or stack[k][0] == "p":
                    pop_to(k)
                elif stack[k][0] in _STOPS:
                    break
        if tag not in _VOID and not m["rest"].endswith("/") and len(stack) < DEEPEST:
            _push(stack, tag, m["rest"])
            anchors += tag == "a"
            heads += tag == "head"
    flush()
    return out


def path_vector(path: tuple) -> np.ndarray:
    """Hashed tag, class, id and role names: those of all ancestors, and apart those of the last two."""
    v = np.zeros(2 * PATH_DIM, np.float32)
    for k, names in enumerate(path):
        for name in names:
            h = zlib.crc32(name.encode(errors="surrogatepass"))
            v[h % PATH_DIM] = 1
            if k >= len(path) - 2:
                v[PATH_DIM + (h >> 8) % PATH_DIM] = 1
    return v


def block_features(blocks: list[tuple[str, tuple, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed-word vectors and plain numbers of all blocks."""
    words = np.zeros((len(blocks), WORD_DIM), np.float32)
    for lo, hi, h, bounds in hashed_words(pa.array([b[0] for b in blocks], pa.large_string())):
        n = np.diff(bounds)
        row = np.repeat(np.arange(hi - lo), n)
        counts = np.bincount(row * WORD_DIM + (h % np.uint64(WORD_DIM)).astype(np.int64), minlength=(hi - lo) * WORD_DIM).reshape(-1, WORD_DIM)
        words[lo:hi] = counts / np.maximum(n, 1)[:, None]
    texts = [b[0] for b in blocks]
    size = np.array([len(t) for t in texts], np.float32).reshape(-1)
    linked = np.array([b[2] for b in blocks], np.float32).reshape(-1)
    flag = lambda test: np.array([test(t) for t in texts], np.float32).reshape(-1)
    numbers = [
        np.log1p(size) / 5, np.minimum(linked / np.maximum(size, 1), 1), flag(lambda t: t[-1:] in ".!?:\"”"), size < 30, size > 200, np.ones_like(size),
        flag(lambda t: "©" in t or "(c)" in t), flag(lambda t: min(sum(map(t.count, (". ", "! ", "? "))), 4) / 4), flag(lambda t: " | " in t or " · " in t or "»" in t or "›" in t),
        flag(lambda t: t[:1].islower()), flag(lambda t: any(map(str.isdigit, t[:40]))), flag(lambda t: min(t.count(" "), 8) / 8)]
    return words, np.hstack([np.stack(numbers, 1).astype(np.float32), hint_features(texts)])


def hint_features(texts: list[str]) -> np.ndarray:
    """The share of a block's words that hint at each kind of part, the greatest of them, and whether it is a line such parts are made of."""
    out = np.zeros((len(texts), NUM_DIM - 12), np.float32)
    for k, t in enumerate(texts):
        if len(t) > 600:
            continue
        found = _TOKEN.findall(t.lower())
        if not found:
            continue
        for w in found:
            if at := _HINTS.get(w):
                out[k, list(at)] += 1
        out[k, :8] /= len(found)
        out[k, 8] = out[k, :8].max()
        out[k, 9] = any(p.search(t) for p in _LINE_PATTERNS) if len(t) < 160 else 0
    return out


class BiLSTM:
    """Two LSTMs, forward and backward, and one logistic unit over both states."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        dims = 2 * PATH_DIM + WORD_DIM + NUM_DIM
        self.p = {f"{k}{d}": (rng.normal(0, s, shape)).astype(np.float32) for d in "fb" for k, s, shape in (("W", 0.1, (dims, 4 * HIDDEN)), ("U", 0.15, (HIDDEN, 4 * HIDDEN)))}
        for d in "fb":  # names and words that no training page has must weigh nothing
            self.p[f"W{d}"][:-NUM_DIM] = 0
        self.p |= {"o": rng.normal(0, 0.1, 2 * HIDDEN).astype(np.float32), "c": np.zeros(1, np.float32)}

    @staticmethod
    def _gates(z: np.ndarray) -> tuple:
        s = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
        return s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])

    def scores(self, paths: np.ndarray, path_of: np.ndarray, words: np.ndarray, numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of each block; blocks of the pages stand one after another, longest page first."""
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        total = np.full(len(path_of), self.p["c"][0], np.float32)
        for d, half in (("f", self.p["o"][:HIDDEN]), ("b", self.p["o"][HIDDEN:])):
            w = self.p[f"W{d}"]
            x = (paths @ w[: 2 * PATH_DIM])[path_of] + words @ w[2 * PATH_DIM : -NUM_DIM] + numbers @ w[-NUM_DIM:]
            h = c = np.zeros((len(lengths), HIDDEN), np.float32)
            for t in range(int(lengths[0]) if len(lengths) else 0):
                n = int(np.searchsorted(-lengths, -t, "left"))
                at = starts[:n] + (t if d == "f" else lengths[:n] - 1 - t)
                i, f, o, g = self._gates(x[at] + h[:n] @ self.p[f"U{d}"])
                c = f * c[:n] + i * g
                h = o * np.tanh(c)
                total[at] += h @ half
        return 1 / (1 + np.exp(-total))

    def train(self, pages: list[tuple], epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 3) -> None:
        """Adam on pages (paths, words, numbers, labels), by back-propagation through time on padded batches."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step, steps = 0, epochs * -(-len(pages) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for lo in range(0, len(pages), batch):
                picked = [pages[k] for k in order[lo : lo + batch]]
                width = max(len(p[3]) for p in picked)
                names: dict[tuple, int] = {}
                at = np.zeros((len(picked), width), np.int64)
                dense = np.zeros((len(picked), width, WORD_DIM + NUM_DIM), np.float32)
                y, mask = np.zeros((len(picked), width), np.float32), np.zeros((len(picked), width), np.float32)
                for k, (paths, words, numbers, labels) in enumerate(picked):
                    at[k, : len(labels)] = [names.setdefault(p, len(names)) for p in paths]
                    dense[k, : len(labels)] = np.hstack([words, numbers])
                    y[k, : len(labels)] = labels
                    mask[k, : len(labels)] = 1
                grads = self._gradients(np.stack([path_vector(p) for p in names]), at, dense, y, mask)
                step += 1
                now = rate * min(1.0, 2 - 2 * step / steps)
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def _gradients(self, paths: np.ndarray, at: np.ndarray, dense: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss, for blocks (page, place) with the path ``paths[at]`` and the other features ``dense``."""
        n, steps = at.shape
        flat = dense.reshape(n * steps, -1)
        kept, states = {}, []
        for d in "fb":
            w = self.p[f"W{d}"]
            zx = (paths @ w[: 2 * PATH_DIM])[at] + (flat @ w[2 * PATH_DIM :]).reshape(n, steps, -1)
            h = c = np.zeros((n, HIDDEN), zx.dtype)
            hs, trace = np.zeros((n, steps, HIDDEN), zx.dtype), {}
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                i, f, o, g = self._gates(zx[:, t] + h @ self.p[f"U{d}"])
                m = mask[:, t : t + 1]
                new = f * c + i * g
                trace[t] = (i, f, o, g, c, new, h, m)
                c = m * new
                h = m * (o * np.tanh(new))
                hs[:, t] = h
            kept[d] = trace
            states.append(hs)
        both = np.concatenate(states, 2)
        p = 1 / (1 + np.exp(-(both @ self.p["o"] + self.p["c"])))
        err = (p - y) * mask / mask.sum()
        grads = {"o": np.einsum("nt,nth->h", err, both), "c": np.array([err.sum()], both.dtype)}
        for k, d in enumerate("fb"):
            out = self.p["o"][k * HIDDEN : (k + 1) * HIDDEN]
            gw, gu = np.zeros((n, steps, 4 * HIDDEN), both.dtype), np.zeros_like(self.p[f"U{d}"])
            dh = dc = np.zeros((n, HIDDEN), both.dtype)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                i, f, o, g, c, new, h, m = kept[d][t]
                dh = m * (dh + err[:, t : t + 1] * out)
                tc = np.tanh(new)
                dn = m * dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dn * g * i * (1 - i), dn * c * f * (1 - f), dh * tc * o * (1 - o), dn * i * (1 - g * g)], 1)
                gw[:, t] = dz
                gu += h.T @ dz
                dh, dc = dz @ self.p[f"U{d}"].T, dn * f
            gw = gw.reshape(n * steps, -1)
            by_path = np.zeros((len(paths), gw.shape[1]), gw.dtype)
            np.add.at(by_path, at.ravel(), gw)
            grads[f"W{d}"] = np.vstack([paths.T @ by_path, flat.T @ gw])
            grads[f"U{d}"] = gu
        return grads


#: How training pages name their parts (wrappers, and words that hint at the kind), and names that say nothing.
PARTS = {
    "menu": ("nav nav.main-menu div.menu div#navigation ul.nav div.navbar header>nav div.breadcrumbs div.topbar div#menu ul.menu nav>div.inner div.toolbar div.links", "home about contact menu products blog archive login news services skip help store jobs next previous index sitemap"),
    "header": ("header div.header div#header div.site-header div.masthead div#top div.hd div.head div.top div.logo div.branding", "welcome search site your official portal online"),
    "sidebar": ("aside aside.sidebar div.sidebar div#sidebar div.widget section.related div.related-posts div.popular aside.right div.col-right div.right div#secondary div.recommended div.rail div.trending", "related popular recent tags more posts read latest trending categories also archives"),
    "notice": ("div.notice div.cookie div#cookie-banner div.alert div.consent div.banner div.newsletter div.popup div.gdpr section.subscribe div.share div.social div.modal div.toast div.promo-signup", "cookies accept privacy subscribe newsletter share follow sign agree consent facebook twitter email policy"),
    "advert": ("div.ad div.ads div.advert div.advertisement aside.ad div#ad div.sponsored div.promo ins.adsbygoogle section.ad div.ad-slot div.banner-ad", "sponsored buy offer sale advertisement advertisement shop discount free"),
    "form": ("form form.search div>form form#login form.contact form.signup", "name email submit password send search required username message"),
    "comments": ("section.comments div.comments div#comments ol.comment-list div.comment section#responses article.comment div.discussion div#disqus ul.replies", "reply says comment comments ago posted wrote report likes replies"),
    "footer": ("footer div.footer div#footer footer.site-footer div.copyright div.legal div.ft div.foot div.bottom div.colophon", "copyright rights reserved terms privacy policy inc all contact"),
}
#: The same hints in German, French and Spanish.
ABROAD = {
    "menu": "startseite über kontakt produkte archiv anmelden nachrichten hilfe weiter zurück accueil contact produits actualités connexion aide suivant inicio contacto productos noticias ayuda siguiente",
    "header": "willkommen suche bienvenue recherche bienvenidos buscar portal",
    "sidebar": "verwandte beliebt neueste beiträge mehr lesen articles liés populaires récents lire relacionados populares recientes leer más",
    "notice": "cookies akzeptieren datenschutz newsletter abonnieren teilen folgen accepter confidentialité abonnez partager suivez aceptar privacidad suscríbete compartir síguenos",
    "advert": "anzeige werbung kaufen angebot rabatt gratis publicité achetez offre gratuit publicidad compra oferta gratis",
    "form": "name passwort senden suchen nom envoyer rechercher nombre contraseña enviar buscar",
    "comments": "kommentare antworten schrieb vor stunden commentaires répondre écrit comentarios responder escribió",
    "footer": "impressum datenschutz rechte vorbehalten agb droits réservés mentions légales derechos reservados aviso legal condiciones",
}
#: Whole lines that such parts are made of; a dot at an end may be left out, and _ stands for any word.
LINES = {
    "notice": ["We use cookies to _ your experience.", "This site uses cookies. By continuing you accept our _ policy.", "Share this article", "Share this:", "Share on Facebook", "Subscribe to our newsletter and never miss a _ again.", "Sign up for our newsletter", "Follow us on Twitter", "Like what you read? Subscribe to _ today.", "Get the best of _ in your inbox every week.",
               "Diese Seite verwendet Cookies.", "Wir verwenden Cookies, um _ zu _.", "Artikel teilen", "Jetzt unseren Newsletter abonnieren", "Ce site utilise des cookies pour _.", "Partager cet article", "Abonnez-vous à notre newsletter", "Este sitio utiliza cookies para _.", "Comparte este artículo", "Suscríbete a nuestro boletín"],
    "advert": ["Advertisement", "Sponsored", "Ad", "Promoted", "Sponsored content", "Anzeige", "Werbung", "Publicité", "Publicidad", "Contenu sponsorisé"],
    "footer": ["Copyright 2020 _. All rights reserved.", "All rights reserved.", "Terms of use. Privacy policy.", "_ is a trademark of _ Inc.", "Contact us | Terms | Privacy", "Powered by _", "Impressum | Datenschutz | Kontakt", "Alle Rechte vorbehalten.", "Tous droits réservés.", "Mentions légales", "Todos los derechos reservados.", "Aviso legal"],
    "sidebar": ["Related articles", "You may also like", "Most read", "More from _", "Read more", "Read also: _ _ _", "Mehr zum Thema", "Das könnte Sie auch interessieren", "À lire aussi", "Te puede interesar"],
    "comments": ["Leave a reply", "2 comments", "Comments (_)", "Join the discussion", "Kommentare", "Schreibe einen Kommentar", "Laisser un commentaire", "Deja un comentario"],
}
BODIES = "article main>article main div.content div#content div.post div.entry-content section.article div.article-body div#main div.page>article div.container>main div.story article.post table>tr>td.content div.text div#mw-content-text div.body div.prose section div>div".split()
#: Words of any text in four languages, so that they hint at nothing.
PLAIN_WORDS = "the of and to in a is that it for on with as was at by this from be are we you they not have will his her or an all more der die das und in zu den von mit ist nicht ein eine auf für es im dem wir sie le la les de des et en un une que est pour dans sur au nous vous el los las y que se por con para una del su al lo".split()
NEUTRAL = "col left center box wrap inner row container block page bd mod item c1 grid cell outer unit area panel layer w100 clearfix region group one two".split()


_TOKEN = re.compile(r"[^\W\d_]+")
_HINTS: dict[str, tuple[int, ...]] = {}
for _k, _kind in enumerate(sorted(PARTS)):
    for _w in {*_TOKEN.findall(" ".join((PARTS[_kind][1], ABROAD[_kind], *LINES.get(_kind, ()))).lower())} - set(PLAIN_WORDS):
        _HINTS[_w] = (*_HINTS.get(_w, ()), _k)
_LINE_PATTERNS = [re.compile("^" + r"[\w.&' -]+".join(re.escape(x.rstrip(".")) for x in re.sub("2020|^2", "_", line).split("_")), re.I) for lines in LINES.values() for line in lines]


def _element(wrap: str) -> tuple[str, str]:
    opened, closed = "", ""
    for part in filter(None, wrap.split(">")):
        tag = re.match(r"\w+", part)[0]
        opened += f"<{tag}" + (f' class="{part.split(".", 1)[1]}"' if "." in part else f' id="{part.split("#", 1)[1]}"' if "#" in part else "") + ">"
        closed = f"</{tag}>" + closed
    return opened, closed


class _Page:
    """A page being made by rule: its html, and for each of its leaf blocks whether it is main text."""

    def __init__(self, rng: random.Random):
        self.rng, self.html, self.labels = rng, [], []
        self.junk = rng.choice(("", "", "", "", "###", "$$$", "!!", " |", "***"))
        self.usual = rng.choice((0.0, 0.1, 0.3, 0.45))
        self.syllables = [a + b for a in "b d f g k l m n p r s t v w th sh".split() for b in "a e i o u an er in on".split()]
        # Layouts without telling names: parts must be told by their text and place.
        self.plain = rng.random() < 0.5
        # Others are one table, with a row for each part.
        self.table = self.plain and rng.random() < 0.3
        self.html += [rng.choice(("<table>", "<table width='100%'>", "<table border=0><tbody>"))] * self.table

    def word(self) -> str:
        return "".join(self.rng.choices(self.syllables, k=self.rng.choice((1, 1, 2, 2, 3, 4))))

    def words(self, n: int, hints: str = "", share: float = 0.0) -> str:
        known = hints.split()
        plain = self.usual
        return " ".join(self.rng.choice(known) if known and self.rng.random() < share else self.rng.choice(PLAIN_WORDS) if self.rng.random() < plain else self.word() for _ in range(n))

    def sentence(self, n: int, hints: str = "", share: float = 0.0) -> str:
        made = self.words(n, hints, share)
        return (made.replace(" ", self.junk + " ") + self.junk if self.junk else made).capitalize()

    def prose(self, low: int, high: int) -> str:
        any_hint = " ".join(h for _, h in PARTS.values())
        out = ""
        for _ in range(self.rng.choice((1, 1, 2, 3, 4))):
            s = self.sentence(self.rng.randint(low, high), any_hint, 0.04)
            if self.rng.random() < 0.15:
                first, _, rest = s.partition(" ")
                s = f'{first} <{(t := self.rng.choice(("a", "b", "em", "i", "strong")))}>{self.word()}</{t}> {rest}'
            out += s + self.rng.choice((". ", ". ", ". ", "! ", "? "))
        return out.strip() if self.rng.random() < 0.95 else out.strip(".!? ")

    def line(self, kind: str) -> str:
        """A whole line as such parts have it."""
        text = re.sub("_", lambda _: self.word(), self.rng.choice(LINES[kind]))
        text = re.sub("2020|^2", lambda m: str(self.rng.randint(1996, 2026) if len(m[0]) > 1 else self.rng.randint(2, 90)), text)
        return text.rstrip(".") if self.rng.random() < 0.2 else text

    def add(self, tag: str, text: str, label: int) -> None:
        self.html.append(f"<{tag}>{text}</{tag.split(' ')[0]}>" if tag else text)
        self.labels.append(label)

    def wrapper(self, telling: str) -> tuple[str, str]:
        """Opening and closing tags: telling ones, or with names that say nothing, or none."""
        r = self.rng
        if self.table:
            return "<tr><td>", "</td></tr>"
        if not self.plain and r.random() < 0.75:
            return _element(r.choice(telling.split()))
        tag = r.choice(("div", "div", "div", "section", "table>tr>td", "tr>td", "div>div"))
        name = r.choice(NEUTRAL) if r.random() < 0.5 else self.word()
        return _element(tag + r.choice(("", f".{name}", f"#{name}", f".{name}-{r.choice(NEUTRAL)}")))

    def part(self, kind: str, named: bool = False) -> None:
        """One part that is not main text. Without a telling wrapper, its own text tells."""
        r, (wraps, hints) = self.rng, PARTS[kind]
        hints = r.choice((hints, hints, f"{hints} {ABROAD[kind]}", ABROAD[kind]))
        opened, closed = _element(r.choice(wraps.split())) if named or kind in ("advert", "form") and not self.plain else self.wrapper(wraps)
        self.html.append(opened)
        telling = any(opened == _element(w)[0] for w in wraps.split())
        link = lambda text: f'<a href="/{self.word()}">{text}</a>'
        few = lambda share=0.5: self.words(r.randint(1, 3), hints, share).capitalize()
        if kind in ("menu", "sidebar") or kind in ("footer", "header") and r.random() < 0.3:
            if kind == "sidebar" and (r.random() < 0.6 or not telling):
                self.add(r.choice(("h2", "h3", "h4", "div", "p")), self.line("sidebar") if r.random() < 0.5 else few(0.8), 0)
            n, form = r.randint(2, 9), r.choice(("ul", "ul", "div", "line", "p", "p"))
            if form == "line":
                self.add(r.choice(("p", "div", "")), r.choice((" ", " | ", " · ", " &raquo; ")).join(link(few()) for _ in range(n)), 0)
            else:
                self.html.append("<ul>" if form == "ul" else "")
                for _ in range(n):
                    self.add("li" if form == "ul" else form, link(self.words(r.choice((1, 1, 2, 3, 7)), hints, 0.3).capitalize()), 0)
                self.html.append("</ul>" if form == "ul" else "")
        elif kind == "header":
            for _ in range(r.randint(1, 2)):
                text = few()
                self.add(r.choice(("div", "p", "h2", "h1", "span")), text if telling else link(text), 0)
                self.html.append("<div></div>")
        elif kind == "comments":
            if r.random() < 0.6 or not telling:
                self.add(r.choice(("h2", "h3", "div", "p")), r.choice((f"{r.randint(1, 40)} {r.choice(('comments', 'replies', 'responses', 'Kommentare', 'commentaires', 'comentarios'))}".capitalize(), self.line("comments"))), 0)
            for _ in range(r.randint(1, 5)):
                inner = _element(r.choice(("div.comment", "article", "li", "div.body", "div", "p")))
                self.html.append(inner[0])
                if r.random() < 0.7 or not telling:
                    self.add(r.choice(("div", "h4", "p") if inner[0] != "<p>" else ("",)), r.choice((f"{self.word()} {r.choice(('says:', 'wrote:', 'schrieb:', 'a écrit :', 'escribió:', f'{r.randint(2, 20)} hours ago', 'posted'))}", self.word().capitalize(), f"{self.words(2).title()}, {r.randint(1, 28)} {self.word()} {r.randint(2001, 2026)}")), 0)
                    self.html.append("<div></div>")
                self.add(r.choice(("p", "div")), self.prose(2, 14), 0)
                if r.random() < 0.5:
                    self.add("a href='#'" if r.random() < 0.5 else "div", r.choice(("Reply", "Like", "Reply Share", "Report", "Antworten", "Répondre", "Responder")), 0)
                self.html.append(inner[1])
        elif kind == "form":
            for _ in range(r.randint(1, 4)):
                self.add(r.choice(("label", "p", "div", "button")), few(0.7), 0)
                self.html.append("<div><input name='q'></div>")
        elif kind == "footer":
            for k in range(r.randint(1, 3)):
                if r.random() < 0.5:
                    self.add(r.choice(("p", "div", "")), " ".join(self.line("footer") for _ in range(r.choice((1, 1, 2)))), 0)
                    self.html.append("<div></div>")
                    continue
                self.add(r.choice(("p", "div", "")), r.choice(("&copy; ", "Copyright &copy; ", "(c) ") if not telling else ("&copy; ", "", "Copyright ")) + r.choice(("", str(r.randint(1999, 2026)) + " ")) + self.sentence(r.randint(1, 14), hints, 0.3) + r.choice((".", "", " &middot; " + self.sentence(4, hints, 0.3))), 0)
                self.html.append("<div></div>")
        else:
            share = 0.1 if telling else 0.5
            if kind == "advert" and (not telling or r.random() < 0.3):
                self.add(r.choice(("div", "p", "span", "h3")), self.line("advert"), 0)
                self.html.append("<div></div>")
            if kind == "notice" and r.random() < 0.6:
                self.add(r.choice(("p", "div", "", "span")), self.line("notice"), 0)
                self.html.append("<div></div>")
                if r.random() < 0.5:
                    self.html.append(closed)
                    return
            for _ in range(r.choice((1, 1, 2, 3))):
                self.add(r.choice(("p", "div", "", "h3")), self.sentence(r.randint(2, 16), hints, share) + r.choice((".", "", "!")) + (" " + link(few()) if r.random() < 0.3 else ""), 0)
                self.html.append("<div></div>")
            if kind == "notice" and r.random() < 0.5:
                self.add("button", few(0.8), 0)
        self.html.append(closed)

    def main_block(self) -> None:
        """One paragraph, list, table or the like of the main text."""
        r = self.rng
        kind = r.choice("p p p p p p p br head head list list table quote pre dl figure bare nest".split())
        if kind == "p":
            self.add(r.choice(("p", "p", "p", "p", "div", "p class='x'")), self.prose(1, r.choice((4, 12, 30))), 1)
        elif kind == "br":
            self.html.append("<p><b>")
            self.add("", self.sentence(r.randint(1, 20)) + ".<br>", 1)
            self.add("p", self.prose(3, 20), 1)
        elif kind == "head":
            self.add(r.choice(("h2", "h3", "h4", "h5", "h6", "h2")), self.sentence(r.randint(1, 8), " ".join(h for _, h in PARTS.values()), 0.08), 1)
            self.add("p", self.prose(4, 25), 1)
        elif kind == "list":
            tag, linked = r.choice(("ul", "ul", "ol")), r.random() < 0.12
            self.html.append(f"<{tag}>")
            for _ in range(r.randint(1, 6)):
                text = self.words(r.randint(1, 12)).capitalize() + r.choice((".", "", ";"))
                self.add("li", f"<a href='/x'>{text}</a> {self.words(3)}" if linked else text, 1)
            self.html.append(f"</{tag}>")
        elif kind == "table":
            self.html.append(r.choice(("<table>", "<table class='t'><tbody>")))
            for k in range(r.randint(1, 4)):
                self.html.append("<tr>")
                for _ in range(r.randint(2, 4)):
                    self.add("th" if not k and r.random() < 0.6 else "td", r.choice((self.words(r.randint(1, 3)), str(r.randint(0, 9999)), f"{r.randint(1, 99)} %")), 1)
                self.html.append("</tr>")
            self.html.append("</table>")
        elif kind == "dl":
            self.html.append("<dl>")
            self.add("dt", self.words(2), 1)
            self.add("dd", self.prose(2, 10), 1)
            self.html.append("</dl>")
        elif kind == "figure":
            self.html.append("<figure><img src='a.png'>")
            self.add("figcaption", self.sentence(r.randint(2, 10)), 1)
            self.html.append("</figure>")
        elif kind == "bare":
            self.html.append("<div></div>")
            self.add("", self.prose(1, 14), 1)
            self.html.append("<div></div>")
        elif kind == "nest":
            opened, closed = self.wrapper(" ".join(BODIES))
            self.html.append(opened)
            for _ in range(r.randint(1, 3)):
                self.add("p", self.prose(3, 20), 1)
            self.html.append(closed)
        else:
            self.add({"quote": "blockquote", "pre": "pre"}[kind], self.prose(2, 14), 1)


def training_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page made by rule, and for each of its leaf blocks whether it is main text."""
    page = _Page(rng)
    if rng.random() < 0.06:
        for _ in range(rng.randint(1, 3)):
            w = page.words(rng.randint(1, 8))
            page.add(rng.choice(("p", "p", "div", "", "h1", "span", "pre")), (w if rng.random() < 0.4 else w.capitalize()) + rng.choice(("", "", ".", "!")), 1)
            page.html.append("<hr>")
        return "".join(page.html), page.labels
    bare = rng.random() < 0.12
    if rng.random() < 0.03:
        for kind in rng.sample(sorted(PARTS), 3):
            page.part(kind, named=True)
        return "<html><body>" + "".join(page.html) + "</body></html>", page.labels
    if not bare:
        for kind in ("header", "menu", "notice", "advert"):
            if rng.random() < 0.45:
                page.part(kind)
        if rng.random() < 0.2:
            page.part("sidebar")
    opened, closed = ("", "") if bare and rng.random() < 0.5 else page.wrapper(" ".join(BODIES))
    page.html.append(opened)
    if rng.random() < 0.75:
        inside = rng.random() < 0.15
        page.html.append("<header>" if inside else "")
        page.add(rng.choice(("h1", "h1", "h1", "h2")), page.sentence(rng.randint(1, rng.choice((3, 14)))), 1)
        if rng.random() < 0.3:
            page.add(rng.choice(("p", "div", "p class='byline'", "div class='meta'")), rng.choice((f"By {page.words(2).title()}", f"By {page.words(2).title()}, {rng.randint(1, 28)} {page.word()} {rng.randint(1999, 2026)}", f"{rng.randint(1, 28)} {page.word()} {rng.randint(1999, 2026)}")), 1)
        page.html.append("</header>" if inside else "")
    for _ in range(rng.choice((1, 1, 2, 3, 4, 6, 8, 10))):
        page.main_block()
        if rng.random() < 0.09:
            # In the midst of the text, by name or by nothing but its own words and place.
            if rng.random() < 0.35:
                page.add(rng.choice(("p", "div", "h4", "p class='x'")), page.line(rng.choice(("notice", "notice", "sidebar"))), 0)
            else:
                page.part(rng.choice(("advert", "advert", "notice", "notice", "form", "sidebar")), named=rng.random() < 0.4)
    page.html.append(closed)
    if not bare:
        for kind in ("notice", "sidebar", "form", "comments", "advert", "footer"):
            if rng.random() < (0.6 if kind == "footer" else 0.4):
                page.part(kind)
    return "<html><body>" + "".join(page.html) + "</body></html>", page.labels


_models: dict[tuple, BiLSTM] = {}


def trained(pages: int = 3200, seed: int = 11) -> BiLSTM:
    """The labeller, fitted on ``pages`` pages made by rule; fitted once in a driver."""
    if (pages, seed) not in _models:
        rng = random.Random(seed)
        made = []
        while len(made) < pages:
            page, labels = training_page(rng)
            blocks = leaf_blocks(page)
            if len(blocks) == len(labels) and 0 < len(blocks) <= 64:
                made.append(([b[1] for b in blocks], *block_features(blocks), labels))
        model = BiLSTM()
        model.train(made)
        _models[pages, seed] = model
    return _models[pages, seed]


def main_texts(pages: list[str], model: BiLSTM, group: int = 256, threshold: float = 0.5) -> list[str]:
    """The main text of each page: its blocks that the model accepts, one a line."""
    out = [""] * len(pages)
    cache: dict[tuple, int] = {}
    vectors: list[np.ndarray] = []
    for lo in range(0, len(pages), group):
        parsed = sorted(((k, leaf_blocks(pages[k])) for k in range(lo, min(lo + group, len(pages)))), key=lambda p: -len(p[1]))
        flat = [b for _, blocks in parsed for b in blocks]
        if not flat:
            continue
        if len(cache) > 4096:
            cache.clear()
            vectors.clear()
        ids = np.empty(len(flat), np.int64)
        for i, b in enumerate(flat):
            at = cache.get(b[1])
            if at is None:
                at = cache[b[1]] = len(vectors)
                vectors.append(path_vector(b[1]))
            ids[i] = at
        words, numbers = block_features(flat)
        good = model.scores(np.stack(vectors), ids, words, numbers, np.array([len(b) for _, b in parsed])) >= threshold
        at = 0
        for k, blocks in parsed:
            out[k] = "\n".join(b[0] for b, ok in zip(blocks, good[at : at + len(blocks)]) if ok)
            at += len(blocks)
    return out


def extract(pages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars (code points).

    The whole html is read. Null or empty html, or a page without main text,
    gives an empty string; equal rows give equal rows.
    """
    ensure_importable(pages.sparkSession)
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = main_texts([v or "" for v in part.column(2).to_pylist()], model, threshold=threshold)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
