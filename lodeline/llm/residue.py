"""Problem 8: template residue, filler, error pages and script notices.

Text cells are cut into fragments: sentences, and the slots of templates. In a
fragment numbers, addresses, dates, references and the names of slots, runs of
typing noise and of pseudo-Latin are masked and it is normalised; equal fragments
have equal hashes. All of them are counted over documents and sources. What
recurs widely is classed by phrase and placeholder rules, and the documents that
hold a classed group are found. Nothing is found by a rule alone: a fragment too
rare to be a template or a server's message is not.

Phrase rules pair a thing with what happened to it (page + not found, access +
denied, scripts + enable) in several languages; none is a whole message.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.cells import TEXT, cells
from lodeline.session import cut_lineage

#: Classes of fragments. A LOOSE slot has delimiters that genuine text uses too; its name must be one that templates use.
NONE, ERROR, SCRIPT, FILLER, SLOT, NAME, LOOSE = 0, 1, 2, 3, 4, 5, 6

#: A fragment recurs widely from so many documents and sources on.
MIN_DOCUMENTS, MIN_SOURCES = 5, 3

# a message has no blank lines, so what opens and closes in it may be wrapped
_SPLIT = re.compile(r"\n[ \t >*]*(?:\n[ \t >*]*)+")
_SPAN = re.compile(r"```.*?```|``.+?``|`[^`]*`", re.S)
_MATH = re.compile(r"\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)|(?<![\\\w$])\$(?![{(\s$])[^$]+?(?<!\s)\$(?![\w{(])", re.S)
_QUOTED = re.compile(r"\"[^\"]+\"|“[^”]+”|„[^“”]+[“”]")
_TAG = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>", re.I)

_L = r"[\w\u0300-\u036f\u064b-\u0652\u0900-\u0dff\u0e31-\u0e4e]"  # letters with their marks
_W = rf"[^\W\d]{_L}*(?:[ \-][^\W\d]{_L}*)*"  # a slot's name
#: Styles of slots: what opens, what closes, and whether nothing but a template writes so.
_STYLES = [
    ("{{", rf"(?<![\^_\w\\}}{{$])\{{\{{\s*(?:{_W}\.)*({_W})\s*(?:\|[^{{}}]*)?\}}\}}", SLOT),
    ("{%", r"\{%-?\s*\w+([^%]*)%\}", SLOT),
    ("<%", r"<%=?\s*([^%<>]+)%>", SLOT),
    ("${", rf"(?<![\w$])\$\{{\s*({_W})\s*\}}", SLOT),
    ("$(", rf"(?<![\w$])\$\(\s*({_W})\s*\)(?!\$)", SLOT),
    ("#{", rf"(?<!\w)\#\{{\s*({_W})\s*\}}", SLOT),
    ("%(", rf"%\(\s*({_W})\s*\)[sdfr](?!\w)", SLOT),
    ("@@", rf"(?<![\w@])@@\s*({_W})\s*@@(?![\w@])", SLOT),
    ("%%", rf"(?<![\w%])%%\s*({_W})\s*%%(?![\w%])", SLOT),
    ("[[", rf"(?<!\[)\[\[\s*({_W})\s*\]\](?!\])", SLOT),
    ("<<", rf"<<\s*({_W})\s*>>", SLOT),
    ("[insert", rf"[\[<(]\s*insert\s+(?:your\s+)?({_W})\s*[\]>)]", SLOT),
    ("[here", rf"[\[<(]\s*(?:your\s+)?({_W})\s+(?:goes\s+)?here\s*[\]>)]", SLOT),
    ("[your", rf"[\[<(]\s*your\s+({_W})\s*[\]>)](?!\()", SLOT),
    ("[tbd", r"[\[<(]\s*(tbd|tba|todo|fill\s+in|fill\s+me\s+in|to\s+be\s+(?:added|done|written|completed|filled\s+in))\s*[\]>)](?!\()", SLOT),
    ("{{{", rf"(?<!\{{)\{{\{{\{{\s*({_W})\s*\}}\}}\}}(?!\}})", SLOT),
    ("[%", rf"\[%-?\s*({_W})\s*-?%\]", SLOT),
    ("~~", rf"~~\s*({_W})\s*~~\s*\(fill\s+in\)", SLOT),
    ("[", rf"(?<![\]\w\[!])\[\s*({_W})\s*\](?![\](\[:])", LOOSE),
    ("«", rf"«\s*({_W})\s*»", LOOSE),
    ("{", rf"(?<![\w\\^$#{{}}%])\{{\s*({_W})\s*\}}(?!\}})", LOOSE),
    ("__", rf"(?<!\w)__({_W})__(?!\w)", LOOSE),
]
_SLOT = re.compile("|".join(f"(?:{p})" for _, p, _ in _STYLES), re.I)
_TRIGGER = re.compile(r"[{}<>\[\]«@%$~#]|__|\((?=\s*(?:insert|your|add|tb[ad]|todo|fill|to be|\w[^()]*here))", re.I)

_SENTENCE = re.compile(r"[.!?:…;\n|]+(?:\s|$)|[。！？]")
_WORD = re.compile(rf"[^\W_](?:{_L})*")
_ADDRESS = re.compile(r"(?:https?://|www\.)\S+|[\w.+-]+@[\w-]+\.[\w.]+|\b\d{1,3}(?:\.\d{1,3}){3}\b", re.I)
_DATE = re.compile(r"\b\d{4}-\d\d?-\d\d?(?:[T ]\d\d?:\d\d(?::\d\d(?:\.\d+)?)?Z?)?\b|\b\d\d?[./]\d\d?[./]\d{2,4}\b")
_NUMBER = re.compile(r"\b[0-9a-f]*\d[0-9a-f]*\b", re.I)
#: A number in brackets, with a word at most: the number of an incident.
_STATUS = re.compile(r"(?<!\w)(?:http|error|status|code)\s*#(?=\W|$)", re.I)
_REFERENCE = re.compile(r"[\[(]\s*(?:[^\W\d]+[:.]?\s*)?#(?:date|address)?\s*[\])]")


def _any(*words: str) -> str:
    return "(?:" + "|".join(words) + ")"


#: Phrase rules by class: each is what a fragment must hold, in any order. Words are folded and parted by single blanks.
_THING = _any(
    "pages?", "files?", "documents?", "sites?", "websites?", "resources?", "notebooks?", "links?", "urls?", "contents?", "previews?", "servers?", "services?", "sessions?", "viewers?", "connections?", "repositor(?:y|ies)", "items?", "videos?", "images?", "apps?", "applications?", "accounts?", "articles?", "posts?", "projects?", "profiles?",
    "seite", "datei", "dokument", "inhalt", "verbindung", "sitzung", "dienst", "fichier", "lien", "contenu", "carnet", "página", "pagina", "archivo", "documento", "enlace", "contenido", "cuaderno", "sesión", "servicio",
    "arquivo", "conteúdo", "caderno", "sessão", "serviço", r"страниц\w*", r"файл\w*", r"документ\w*", r"блокнот\w*", r"ссылк\w*", r"сесси\w*", r"сервис\w*",
)
_GONE = _any(
    "not found", r"(?:can ?not|can t|could not|couldn t|not) be (?:found|located|loaded|displayed|opened|reached|shown)", "(?:isn t|aren t|not) (?:currently )?available", "(?:is|are) private", "(?:was|were) (?:moved|removed|deleted)", "suspended", "broken", r"can t be found", "cannot be found", "no longer (?:exists?|available)", "(?:do|does) not exist", "doesn t exist", "(?:has|have) (?:moved|expired|ended)", "(?:has|have) been (?:moved|removed|deleted)", "unavailable",
    "(?:is|are) (?:down|missing|not available|gone)", "too (?:big|large)", "(?:session|link) (?:expired|ended)", "timed out",
    "nicht gefunden", "existiert nicht", "nicht (?:mehr )?verfügbar", "abgelaufen", "introuvable", "n existe (?:pas|plus)", "non trouvée?", "plus disponible", r"expirée?",
    r"no encontrad[ao]", "no se encontr[óo]", "no encontramos", "no existe", "no (?:está )?disponible", "não (?:está )?disponível", r"caducad[ao]", r"expirad[ao]", r"não encontrad[ao]", "não encontramos", "não existe", "indisponível",
    r"не найден\w*", "не существует", r"недоступ\w*", r"удал[её]н\w*", "истекла",
)
_FAIL = _any("could not", "couldn t", "cannot", "can t", "unable to", "failed to", "were not able to")
_DO = _any("find", "load", "loaded", "display", "displayed", "open", "opened", "render", "rendered", "show", "shown", "retrieve", "fetch", "access", "connect", "reach", "reached")
_SCRIPTS = _any("javascript", "js", "noscript", "scripting", "script execution", "skriptausführung")
#: A script is many a thing; beside this word something must speak of a browser, of a page, or of what is switched.
_ANY_SCRIPT = _any("scripts?", "skripte?", r"скрипт\w*")
_SWITCH = _any(
    "enabled?", "activate", "activated", "allow", "allowed", "turn(?:ed)? (?:on|off|them on|it on)", "switch(?:ed)? (?:on|off)", "required?", "requires", "needs?", "needed", "disabled", "blocked", "supports?", "supporting", "support",
    r"aktivier\w*", r"erlaub\w*", "benötigt", "erforderlich", "deaktiviert", "ausgeschaltet", r"(?:schalten|einschalten)", r"führt keine", r"activez", "activer", "nécessaires?", "requis", r"désactivée?s?", r"autoris\w*", r"activ[ea]r?", r"habilit\w*", r"necesit\w*", "requier[ea]n?", r"desactivad[ao]s?",
    "ative", "ativar", "exige", "requer", r"necess\w*", r"desativad[ao]s?", "включите", r"нужн\w*", r"требу\w*", r"отключ\w*", r"разреш\w*", r"необходим\w*",
)
_BROWSER = _any("browser", "page", "site", "view", "see", "continue", "blocked", "disabled", "off", "seite", "navigateur", "nécessaire", "navegador", "página", r"habilit\w*", r"браузер\w*", r"страниц\w*")
_EAST_SCRIPTS = "javascript|js|脚本|スクリプト|स्क्रिप्ट|जावास्क्रिप्ट|سكريبت|스크립트|자바스크립트"
_EAST_SWITCH = "启用|开启|禁用|需要|允许|打开|有効|無効|必要|許可|オン|सक्षम|تفعيل|تمكين|사용|활성"
_TEXT = _any("texte?", "texto", "textos", "contents?", "copy", "paragraph", "description", "explanation", "title", "name", "summary", "caption", "abstract", "contenu", "contenido", "conteúdo", "inhalt", r"текст\w*", "описание")
_RULES = {
    ERROR: [
        [r"^(?:error )?(?:page )?not found$|\byou have been blocked\b|\bchecking your browser\b"], [r"\b(?:erreur interne|error interno|erro interno|interner serverfehler|внутренняя ошибка)\b"],
        [rf"\b{_THING}\b", rf"\b{_GONE}\b"], [rf"\b{_FAIL} (?:\w+ )?{_DO}\b"], [r"\bdid not (?:answer|respond)\b|\btook too long\b|\bconnection (?:was )?(?:refused|reset|closed|timed out)\b|\brequest (?:has )?(?:failed|timed out)\b|^gone$"],
        [r"\b(?:access|permission)(?: is| was)? (?:denied|forbidden|refused|required|restricted)\b|\b(?:do not|don t) have (?:permission|access)\b|\bnot (?:authori[sz]ed|allowed|permitted) to (?:view|access|see|open)\b|\bforbidden\b|\b(?:cannot|can t|may not) access\b|\byou need (?:permission|access|authori[sz]ation)\b"],
        [r"\baccess\b", r"\b(?:denied|restricted|refused)\b"], [r"\b(?:keine (?:berechtigung|zugriffsrechte)|keinen zugriff|n avez pas (?:accès|l autorisation|la permission)|no tiene (?:permisos?|acceso)|no está autorizad[ao]|não tem (?:permissão|acesso)|нет (?:доступа|прав))\b"],
        [r"\b(?:internal(?: server)?|server|proxy|application|network|system) error\b|\bbad (?:gateway|request)\b|\bgateway time ?out\b|\brequest time ?out\b"],
        [r"\bsomething (?:went wrong|broke)\b|\b(?:an|unexpected|unknown|unhandled) (?:\w+ )?error (?:has )?occurred\b"], [r"\btoo many requests\b|\brate limit(?:ed| exceeded)\b"], [r"\b(?:down|closed|under|undergoing) (?:for )?(?:\w+ )?maintenance\b"],
        [r"\b(?:sign|log) ?in (?:again )?to (?:continue|view|access|see)\b|\b(?:signed|logged) out\b"],
        [r"\bzugriff (?:verweigert|nicht)|\bzu viele anfragen\b|\bwartungsarbeiten\b", ], [r"\b(?:fehler|problem|störung)\b", r"\b(?:aufgetreten|passiert)\b"], [r"\bnicht (?:angezeigt|geladen|geöffnet) werden\b"],
        [r"\baccès (?:refusé|interdit)|\btrop de requêtes\b|\ben maintenance\b"], [r"\b(?:erreur|panne|problème)\b", r"\b(?:survenue?|produite?|empêche|affichage)\b"],
        [r"\b(?:acceso|acesso) (?:denegado|negado|prohibido|proibido)|\bdemasiadas (?:solicitudes|peticiones)\b|\bmuitas solicitações\b|\b(?:en mantenimiento|em manutenção)\b"], [r"\b(?:error|fallo|problema|erro|falha)\b", r"\b(?:produjo|ocurrió|ocurrido|ocorreu|aconteceu|produzido)\b"],
        [r"\bдоступ (?:запрещ|закрыт|огранич)|\bслишком много запросов\b|\bтехническ\w* работ|\bне удалось (?:показать|загрузить|открыть|найти|отобразить)"], [r"\b(?:ошибка|сбой)\b", r"\b(?:произош\w*|сервера|возник\w*)\b"],
        [r"找不到|未找到|不存在|已失效|无法(?:访问|显示|打开|加载)", r"页|网|文件|文档|链接|资源|笔记本|内容"], [r"拒绝访问|访问被拒|禁止访问|没有权限|无权|请求(?:过多|太多|过于频繁)|会话已过期|系统维护|服务器错误"], [r"错误|故障|出错|异常", r"显示|发生|出现|服务|网络|系统|请求"], [r"服务|网站|系统", r"不可用|维护"], [r"页|文件|内容|链接", r"已被?(?:删除|移除)"],
        [r"見つかりません|見つかりませんでした|存在しません|表示できません|読み込めません|削除されました"], [r"アクセス", r"拒否|禁止|権限|できません"], [r"エラー|障害|問題", r"発生"], [r"メンテナンス中|リクエストが多すぎ|セッション(?:が|の)"],
        [r"नहीं मिला|अस्वीकृत|त्रुटि हुई"], [r"غير موجود|تم رفض|حدث خطأ|غير متاح"], [r"찾을 수 없|거부되었|오류가 발생"],
    ],
    SCRIPT: [[rf"\b{_SCRIPTS}\b", rf"\b{_SWITCH}\b"], [rf"\b{_ANY_SCRIPT}\b", rf"\b{_SWITCH}\b", rf"\b{_BROWSER}\b"], [_EAST_SCRIPTS, _EAST_SWITCH]],
    FILLER: [
        [rf"\b{_TEXT} (?:goes here|here|to follow|to come|pending|coming(?: soon)?|missing|tbd)\b"], [r"^(?:this is )?(?:a |an |some |the )?(?:sample|placeholder|dummy|filler|example) (?:text|content|copy|paragraph|title|description)(?: for layout| only)?$"],
        [rf"\b(?:insert|add|put|enter|type|write|replace)\b", rf"\b{_TEXT}\b", r"\b(?:your|here|own|this)\b"], [rf"^(?:please )?(?:insert|add|enter|type|write|provide|put) (?:\w+ ){{0,3}}?{_TEXT}(?: (?:of|for|about) .+)?$"], [r"^replace (?:me|this|with)\b|^(?:n a )?placeholder$|\b(?:dummy|placeholder|filler) (?:text|content|copy)\b"],
        [rf"\b{_TEXT} to be (?:added|done|written|completed|provided|announced)\b"], [r"^todo (?:add|write|fill|insert|complete|describe|update)\b"], [r"^(?:insert|add|enter|type|write|put) .*\bhere$"], [r"^(?:geben|fügen|ersetzen|schreiben) sie\b|\bhier einfügen\b", r"text|inhalt|beschreibung"],
        [r"^(?:remplacez|saisissez|insérez|entrez|écrivez)\b", r"texte|contenu|description"], [r"^(?:escriba|inserte|ingrese|introduzca|agregue|añada|insira|escreva|digite|adicione)\b", r"texto|contenido|conteúdo|descripción|descrição"], [r"^请?(?:输入|填写|添加)", r"内容|文字|文本|标题|描述"], [r"\blorem ipsum\b"], [r"^(?:tbd|tba|todo|coming soon|under construction|fill me in|write me|to be (?:added|done|written|completed|announced|filled in))$"],
        [r"\bhier\b", r"\b(?:steht|kommt|folgt|einfügen|eingeben)\b", r"\b(?:text|inhalt)\b"], [r"\b(?:platzhaltertext|blindtext|beispieltext|mustertext|text folgt)\b"], [r"\btexte (?:à venir|ici|d exemple|de remplissage|à compléter)\b|\b(?:insérer|insérez|ajoutez|votre) (?:\w+ )?texte\b|\bà compléter\b"],
        [r"\baquí (?:va|irá|el)\b|\btexto (?:de ejemplo|de relleno|aquí|pendiente|de prueba)\b|\b(?:inserte|escriba|agregue) (?:\w+ )?(?:texto|contenido|descripción)\b"], [r"\btexto (?:de exemplo|aqui|fictício|provisório|de preenchimento)\b|\b(?:insira|escreva|adicione) (?:\w+ )?(?:texto|conteúdo|descrição)\b"],
        [r"\b(?:здесь|тут) (?:будет|должен быть|появится)\b", r"текст|описание"], [r"\b(?:введите|вставьте|добавьте|ваш) (?:\w+ )?текст\b|\bпример текста\b|\bтекст заглушка\b"],
        [r"此处|这里|在此|此處", r"填写|输入|内容|文字|文本|添加"], [r"示例文[字本]|占位|待补充|待填写"], [r"ここに", r"本文|テキスト|文章|入力|挿入|入れ"], [r"サンプルテキスト|ダミーテキスト|仮テキスト"], [r"यहाँ (?:पाठ|लिखें|टेक्स्ट)"], [r"النص هنا|أدخل النص|نص تجريبي"], [r"여기에", r"입력|텍스트|내용"],
    ],
}
# rules of the scripts from Hebrew on need only be tried on text that has such letters, the others only on text with others
_EAST = re.compile(r"[\u0590-\uffff]")
_COMPILED = {east: [(kind, [re.compile(p) for p in rule]) for kind, rules in _RULES.items() for rule in rules if bool(_EAST.search("".join(rule))) == east] for east in (False, True)}
_WEST = re.compile(r"[a-zа-я]")

#: Words that a notice or a line of filler has at most; what is longer tells something.
LONGEST = 16

#: Words of the customary pseudo-Latin passage that no living language uses often.
LATIN = frozenset(
    "lorem ipsum dolor amet consectetur adipiscing eiusmod tempor incididunt labore dolore magna aliqua veniam quis nostrud exercitation ullamco laboris"
    " aliquip commodo consequat duis aute irure reprehenderit voluptate velit cillum fugiat pariatur excepteur sint occaecat cupidatat proident culpa officia deserunt mollit laborum".split()
)

#: The rows of a keyboard.
KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_PLACE = {c: (r, i) for r, row in enumerate(KEY_ROWS) for i, c in enumerate(row)}


@lru_cache(1 << 17)
def keyed(word: str) -> bool:
    """Whether a word is typed along one row of the keyboard: at most one step in three isn't to the next key."""
    if len(word) < 3 or word[0] not in _PLACE:
        return False
    places = [_PLACE.get(c) for c in word]
    row = places[0][0]
    if any(p is None or p[0] != row for p in places):
        return False
    steps = [b[1] - a[1] for a, b in zip(places, places[1:], strict=False)]
    on = max(steps.count(1), steps.count(-1))
    return 3 * (len(steps) - on) <= len(steps)


def masked_filler(words: list[str], share: int = 5) -> str | None:
    """The mask of a run of words that are typing noise, pseudo-Latin or one filler word over and over; None for other text.

    share: one word in so many must be of the pseudo-Latin passage.
    """
    n = len(words)
    if n < 2:
        return None
    typed = [w for w in words if keyed(w)]
    # a word that happens to lie on the keys ("were") doesn't make noise
    if 2 * len(typed) > n and (len(set(typed)) > 1 or len(typed[0]) > 4):
        return "#keys"
    known = [w for w in words if w in LATIN]
    distinct = len(set(known))
    if (distinct > 2 and share * len(known) >= n) or (distinct > 1 and 3 * len(known) >= n):
        return "#latin"
    if all(len(w) > 2 and not w.strip("x") for w in words) or set(words) in ({"blah"}, {"bla"}, {"yada"}):
        return "#again"
    return None


def classify(normal: str) -> int:
    """ERROR, SCRIPT, FILLER or NONE of a normalised fragment."""
    if normal in ("#keys", "#latin", "#again"):
        return FILLER
    # scripts without blanks have few words; their length is counted in characters
    if normal.count(" ") >= LONGEST or len(normal) > 12 * LONGEST:
        return NONE
    rules = [*(_COMPILED[False] if _WEST.search(normal) else ()), *(_COMPILED[True] if _EAST.search(normal) else ())]
    return next((kind for kind, rule in rules if all(p.search(normal) for p in rule)), NONE)


def cleaned(message: str) -> str:
    """A message on one line without formulas, code and quotations."""
    text = message
    if "`" in text:
        text = _SPAN.sub(" ", text)
    if "$" in text or "\\" in text:
        text = _MATH.sub(" ", text)
    if '"' in text or "“" in text or "„" in text:
        text = _QUOTED.sub(" ", text)
    return " ".join(text.split())


def slots(text: str) -> list[tuple[str, str, int]]:
    """(style, name, class) of each slot in a text without formulas, code and quotations."""
    out = []
    if _TRIGGER.search(text):
        for m in _SLOT.finditer(text):
            style, _, kind = _STYLES[m.lastindex - 1]
            out.append((style, re.sub(r"[\s\-_]+", " ", m.group(m.lastindex).casefold()).strip(), kind))
    return out


def _weight(word: str) -> int:
    """How many words a run of letters counts for: scripts without blanks have about two letters a word."""
    return 1 if word < "\u2e80" else -(-len(word) // 2)


def sentences(text: str) -> list[tuple[str, int]]:
    """(normal form, words) of the sentences of a cleaned message: masked, folded, words parted by single blanks."""
    if _TRIGGER.search(text):
        text = _TAG.sub(" . ", _SLOT.sub(" ", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = _NUMBER.sub("#", _DATE.sub("#date", _ADDRESS.sub("#address", text)))
    # what an incident's number follows ends there; a status is a number with its label
    text = _STATUS.sub(" ", _REFERENCE.sub(" . ", text)).casefold()
    out, every = [], []
    for sentence in _SENTENCE.split(text):
        words = _WORD.findall(sentence.replace("#date", " ").replace("#address", " "))
        if words:
            every += words
            out.append((masked_filler(words) or " ".join(words), sum(map(_weight, words))))
    # over a whole message fewer words of the passage are enough
    whole = masked_filler(every, 8) if len(out) > 1 else None
    return [(whole, sum(map(_weight, every)))] if whole else out


def messages_of(text: str | None) -> Iterator[str]:
    """The messages of a document's text cells: paragraphs without marks of quotation."""
    for kind, body in cells(text):
        if kind == TEXT:
            for message in _SPLIT.split(body):
                message = re.sub(r"(?m)^[ \t]*>+[ \t]?", "", message) if ">" in message else message
                if message and not message.isspace():
                    yield message


def fragments_of(text: str | None, known: dict[str, int]) -> Iterator[tuple[str, int, bool]]:
    """(normal form, class, whether it stands by itself) of each fragment of a document.

    A sentence stands by itself if sentences of some class make up a third of its
    message or more, a single word if it is the message. Lines may be wrapped or stand for themselves, so a message of
    several is read both ways. A slot gives its style and its name.
    """
    for message in messages_of(text):
        clean = cleaned(message)
        for style, name, kind in slots(clean):
            if kind == SLOT:
                yield f"slot {style}", SLOT, True
                yield f"name {name}", NAME, True
            else:
                yield f"name {name}", LOOSE, False
        readings = [sentences(clean)]
        if "\n" in message.strip():
            readings.append([s for line in message.split("\n") for s in sentences(cleaned(line))])
        for found in readings:
            kinds = []
            for s, _ in found:
                kind = known.get(s)
                if kind is None:
                    if len(known) > 500_000:
                        known.clear()
                    kind = known[s] = classify(s)
                kinds.append(kind)
            total = sum(n for _, n in found)
            alone = any(kinds) and 3 * sum(n for (_, n), k in zip(found, kinds, strict=True) if k) >= total
            for (s, n), k in zip(found, kinds, strict=True):
                # one word is a heading or a cell of a table, unless the message is that word
                yield s, k, bool(k) and alone and (n > 1 or n == total)


def fragments(documents: DataFrame) -> DataFrame:
    """One row per document and distinct fragment: doc_id, source, fragment (hash), kind, proof, sample (only where kind isn't NONE).

    Documents are read where they lie, whole; of a fragment only its hash travels.
    proof: the fragment counts towards its group's being residue (it stands by
    itself, or a template's delimiters say so).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, text, source in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                seen: dict[tuple[str, bool], tuple] = {}
                for normal, kind, proof in fragments_of(text, known):
                    at = (normal, kind == LOOSE)
                    if at not in seen or proof > seen[at][1]:
                        seen[at] = (kind, proof)
                for (normal, _), (kind, proof) in seen.items():
                    code = xxhash.xxh3_64_intdigest(normal) - (1 << 63)
                    for column, x in zip(out, (doc, source, code, kind, proof, normal if kind else None), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int8(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "source", "fragment", "kind", "proof", "sample"])

    return documents.select("doc_id", "text", "source").mapInArrow(run, "doc_id bigint, source string, fragment bigint, kind tinyint, proof boolean, sample string")


def recurrence(found: DataFrame) -> DataFrame:
    """Each fragment over the corpus: fragment, documents, sources, proofs (documents that prove), proof_sources, kind, sample.

    Sources are counted exactly (null and the empty one are one source): each pair of fragment and source is aggregated
    before the shuffle, so a fragment that a third of all documents hold is a row per source and task.
    """
    pairs = found.groupBy("fragment", F.coalesce("source", F.lit("")).alias("source")).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("proof").alias("proofs"), F.max(F.when(F.col("kind") != LOOSE, F.col("kind"))).alias("kind"), F.min("sample").alias("sample"))
    return pairs.groupBy("fragment").agg(
        F.sum("documents").alias("documents"), F.count(F.lit(1)).cast("int").alias("sources"), F.sum("proofs").alias("proofs"), F.count_if(F.col("proofs") > 0).cast("int").alias("proof_sources"), F.max("kind").alias("kind"), F.min("sample").alias("sample"))


def residue_groups(groups: DataFrame, min_documents: int = MIN_DOCUMENTS, min_sources: int = MIN_SOURCES) -> DataFrame:
    """The groups that recur widely and are residue by the rules: fragment, kind.

    A sentence must stand by itself in most of its documents. The name of a slot
    counts if templates' own delimiters hold it widely; it then tells slots of
    looser delimiters from other text.
    """
    wide = groups.where((F.col("proofs") >= min_documents) & (F.col("proof_sources") >= min_sources))
    return wide.where((F.col("kind") == NAME) | (2 * F.col("proofs") > F.col("documents"))).select("fragment", "kind")


def flagged(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, min_sources: int = MIN_SOURCES) -> DataFrame:
    """doc_id of each document that shows residue, filler, an error or a script notice, each id once.

    Every fragment of every document is counted. Found are the documents with a fragment whose group recurs in at
    least ``min_documents`` documents of ``min_sources`` sources and is residue by the rules. Null, empty and blank
    texts are never flagged; rows with equal doc_id count as documents of their own.
    """
    # read once: the fragments' hashes are written to the shared folder, then used twice
    found = cut_lineage(fragments(documents))
    groups = residue_groups(recurrence(found), min_documents, min_sources)
    # a name alone proves nothing of the document that only has it in a proven slot: that slot's style does
    hit = found.where((F.col("kind") != NONE) & (F.col("kind") != NAME)).select("doc_id", "fragment")
    return hit.join(groups.select("fragment"), "fragment", "left_semi").select("doc_id").distinct()


def exclude(documents: DataFrame, **limits: int) -> DataFrame:
    """``documents`` without the flagged ones."""
    return documents.join(flagged(documents, **limits), "doc_id", "left_anti")
