"""Template residue and error-page text: placeholders, filler, error and access messages, notices that scripts are needed.

Each distinct text is brought to one form and classified once, by placeholder rules, which need no recurrence, and by phrase rules: a message told by its whole
wording needs none either. What a page could also say of itself, or what only sounds like a message, counts where the text, its numbers, addresses and dates
masked, recurs over several sources.
"""

from __future__ import annotations

import functools
import re
from re import _parser as _rules
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyq.llm.lookalike import rewriter
from canopyq.session import cut

#: Elements whose text is never a case.
CODE_ELEMENTS = ("script", "style", "pre", "code")
#: Sources over which a text of an unsure kind must recur, and the kinds: notices told by some words only; filler that may be a title; and what only sounds like a message.
LEAST_SOURCES = {"scripts?": 2, "filler?": 2, "message?": 3}
UNSURE = tuple(LEAST_SOURCES)
#: Rows up to which the distinct texts that are residue are broadcast (some 30 bytes each, counted first); beyond, they are joined by a shuffle over SALTS parts of each.
MOST_BROADCAST, SALTS = 500_000, 32

# What an unfilled placeholder looks like.
_NAME = r"[^\W\d][\w.\-]*(?:\([^()\n]*\))?(?:\s*\|\s*\w+)*"
PLACEHOLDER = re.compile(
    r"\{\{[{#/^&>!]?\s*[^{}\n]+?\s*\}?\}\}"
    rf"|[$#]\{{\s*{_NAME}\s*\}}"
    r"|<%[=\-]?[^%\n]+%>|&lt;%[^%\n]+%&gt;|<\?(?:php|=)[^?\n]+\?>"
    r"|\{%-?\s*[^%\n]+%\}"
    rf"|\[\[\s*{_NAME}\s*\]\]"
    r"|\*\|[^*\n]+\|\*"
    rf"|@@\s*{_NAME}\s*@@"
    rf"|%\(\s*{_NAME}\s*\)[sdif]"
    r"|(?<![\w%])%[^\W\d]\w*(?:[.\-]\w+)*%(?!\w)|%[^\W\d]\w*(?:\([^()\n]*\)|(?:\.\w+)+(?:\s*\|\s*\w+)?)%"
    r"|(?<![\w$])\$[^\W\d][\w.\-]*(?:\([^()\n]*\))?(?:\s*\|\s*\w+)?\$(?!\w)"
    rf"|(?<!\w)__{_NAME}?__(?!\w)"
    r"|(?<!\w)__[^\W\d](?:(?!__)[^\n])*__(?!\w)"
    rf"|\{{\s*[^\W\d][\w.\-]*(?:\([^()\n]*\)|\s*\|\s*\w+)?\s*\}}"
    r"|\[\s*(?:insert|enter|add|your|put)\s[^\[\]\n]+\]|\[[^\[\]\n]+\s(?:goes\s+)?here\]"
    r"|\[\s*(?:(?:first|last|full|middle|user|company|customer|client|recipient|sender|product|event|job|city|country)[ _]?(?:name|number|address|title|date|e-?mail)|(?:your|the)[ _]\w+)\s*\]"
    r"|\[object Object\]",
    re.I,
)

# Filler, whole texts.
_THING = r"(?:text|copy|title|heading|headline|caption|description|name|content|paragraph|label|image|quote|summary|subtitle|intro)"
_FILLER = [
    r"(?:todo|tbd|tba|tbc|fixme|nan|undefined|null|none|n/a)(?:: .*)?",
    r"todo (?:add|change|check|fill|fix|insert|replace|translate|update|write)\b.*",
    rf"(?:placeholder|dummy|sample|example|your|insert|enter|add|edit|default|untitled)(?: an?| your| the| some)? {_THING}(?: {_THING})?(?: here| goes here| to be added)?",
    rf"{_THING} (?:goes )?here|{_THING} (?:to be added|to come|coming soon)",
    r"(?:sample text ?)+|(?:test ?){2,}0?|(?:asdf ?)+|(?:qwerty ?)+|x{3,}(?: x+)*|(?:foo|bar|baz)(?: (?:foo|bar|baz))*",
    r"click here to (?:edit|add|change)\b[^.!?]*",
    r"(?:this is )?(?:a )?(?:sample|dummy|placeholder|filler) (?:text|copy)(?: [^.!?]*)?",
    r"texte (?:à venir|d'exemple|de remplissage)|votre texte ici|texto de (?:ejemplo|relleno|exemplo)|(?:su|tu) texto aquí|seu texto aqui",
    r"hier steht ihr text|ihr text hier|beispieltext|platzhalter(?:text)?|mustertext|blindtext",
    r"здесь будет (?:ваш|ваша)? ?(?:текст|заголовок|описание)|ваш текст здесь|пример текста|текст-заполнитель",
    r"ここにテキストを入力(?:してください)?|テキストが入ります|ダミーテキスト|サンプルテキスト|此处输入文字|在此(?:处)?输入(?:文字|内容|文本)|示例文本|占位文本|여기에 (?:텍스트|내용)를? 입력(?:하세요)?|예시 텍스트",
    r"testo (?:di esempio|segnaposto)|il tuo testo qui|tekst przykładowy|tutaj wpisz tekst|twój tekst tutaj|örnek metin|metniniz buraya|văn bản mẫu",
]
FILLER = re.compile("(?:" + "|".join(_FILLER) + ")")
#: What a page could also say of itself, or call its parts.
MAYBE_FILLER = re.compile(rf"coming soon|under construction|(?:(?:placeholder|dummy|sample|example|your|default|untitled) )?{_THING} 0")
#: Words of Latin filler, of which most of a text must be made.
LATIN_FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat "
    "cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)

# What an error message says, by language.
_GONE = (
    r"(?:the |this )?page (?:was |is |could |can )?(?:not (?:be )?found|unavailable)|(?:this|the) page (?:no longer exists|does not exist|has (?:been )?moved)|nothing (?:was|could be) found at this (?:address|url)"
    r"|the (?:page|file|resource) you (?:asked|are looking|requested|were looking) (?:for )?(?:could not|cannot|can't|was not) (?:be )?found"
    r"|page introuvable|page (?:n'existe|n’existe) (?:pas|plus)|seite (?:wurde )?nicht gefunden|página no encontrada|página não encontrada|pagina non trovata|страница не найдена|strona nie (?:została znaleziona|istnieje)|nie znaleziono strony"
    r"|sayfa bulunamadı|không tìm thấy trang|ページが見つかりません(?:でした)?|页面不存在|找不到(?:该|此)?页面|페이지를 찾을 수 없습니다|الصفحة غير موجودة|صفحه (?:پیدا|یافت) نشد|η σελίδα δεν βρέθηκε|पृष्ठ नहीं मिला|ไม่พบหน้า"
)
_DOWN = (
    r"internal server error|(?:the )?service (?:is )?(?:temporarily )?unavailable|the (?:upstream )?server (?:timed out|is not responding|did not respond)|too many requests(?:,? try again later)?|bad gateway|gateway time-?out|not found|forbidden|unauthorized|bad request"
    r"|(?:le )?service est momentanément indisponible|erreur interne du serveur|der dienst ist vorübergehend nicht erreichbar|interner serverfehler|el servidor no responde(?: en este momento)?|error interno del servidor|servicio no disponible"
    r"|сервис временно недоступен|внутренняя ошибка сервера|o servidor não responde|erro interno do servidor|errore interno del server|il servizio non è disponibile|błąd serwera|sunucu hatası"
    r"|サーバーが応答しません|サーバーエラー|服务器暂时无法访问|服务器(?:内部)?错误|서버 오류|서버가 응답하지 않습니다"
)
_SAID = f"(?:{_GONE}|{_DOWN})"
_BEFORE = r"(?:(?:http(?:/0)? ?)?(?:error|erreur|fehler|ошибка|erro|errore|błąd|hata|エラー|错误|오류)? ?0?(?: ?[:：–—-] ?| )|(?:error|erreur|fehler|ошибка|erro|errore|http) ?[:：-]? ?|(?:oops|sorry|apologies|whoops|désolé|lo sentimos|извините|простите|entschuldigung|leider|desculpe|spiacenti|przepraszamy|üzgünüz|xin lỗi|抱歉|对不起|申し訳ありません|죄송합니다)[!,.:;。，、 -]*)"
_AFTER = r"(?:[.!。！?…]*(?: (?:ray|reference id|ref(?:erence)?|request id|incident|code)[ :#][^.!?]*| please (?:sign|log) in again| (?:please )?try again(?: later)?)?[.!。！…]*)"
_FAULT = r".{0,3}[:：] ?(?:call to|undefined|could not|cannot|can't|failed|unable|unexpected|unknown|no such|invalid|access denied|connection|division by).*"
_ERRORS = [
    rf"{_BEFORE}{{0,2}}{_SAID}{_AFTER}",
    rf"(?:http )?0 (?:forbidden|not found|unauthorized|bad gateway|{_DOWN}){_AFTER}",
    rf"(?:http )?0 ok{_AFTER}",
    rf"(?:access|permission) (?:denied|forbidden)(?: to this (?:page|resource|server))?{_AFTER}|accès refusé{_AFTER}|zugriff verweigert{_AFTER}|acceso denegado{_AFTER}|доступ запрещ[её]н{_AFTER}|アクセスが拒否されました{_AFTER}|拒绝访问{_AFTER}",
    rf"your session (?:has )?(?:expired|timed out){_AFTER}|(?:votre session a expiré|ihre sitzung ist abgelaufen|su sesión ha (?:caducado|expirado)|время сессии истекло|セッションの有効期限が切れました|会话已过期){_AFTER}",
    rf"(?:checking (?:if )?your browser|verifying (?:that )?you are (?:a )?human|just a moment|please wait while we (?:check|verify))[^.!?]*{_AFTER}",
    rf"(?:error 0|fatal error|uncaught (?:exception|error|typeerror|referenceerror)|(?:parse|syntax|runtime|database) error){_FAULT}",
    rf"(?:warning|notice|exception){_FAULT}(?:\bline 0|\bcode 0|@).*",
    r"traceback \(most recent call last\).*|at [\w.$]+\([^()]*:0\).*",
]
ERRORS = re.compile("(?:" + "|".join(_ERRORS) + ")")
#: What sounds like a message, sentence by sentence: it must also recur over sources.
_MAYBE = [
    rf"(?:warning|notice|exception){_FAULT}",
    r"(?:(?:sorry|oops|whoops|uh[ -]oh|apologies)[!,. -]*)?(?:something|(?:an?|the) (?:\w+ )?(?:error|problem|exception|issue)) (?:has |have )?(?:went|gone|occurred|happened|was encountered)(?: wrong)?(?: (?:while|when|during|on|in|with|at|processing) .*)?",
    r"(?:(?:http|error)(?:/0)? ?)?0 ?[:–—-]? ?(?:gone|conflict|moved permanently|method not allowed|not acceptable|request time-?out|payment required|payload too large|unprocessable entity|not implemented|insufficient storage)",
    r"(?:sorry|oops|whoops|uh[ -]oh|apologies)[!,. -]*(?:we|this|that|the|your|you|there|it)\b.*(?:n't|not|unable|unavailable|failed|error|problem|moved|removed|expired|blocked|missing).*",
    r"(?:(?:please|kindly) )?(?:try (?:again|reloading|refreshing)|check back|come back|reload (?:the|this) page|refresh (?:the|this) page|go back to the home ?page|return to the home ?page)\b.*",
    r"(?:we|it|the (?:page|server|site)) (?:could not|couldn't|cannot|can't|(?:was|were) unable to|failed to) (?:load|find|open|process|complete|reach|connect|display|access|retrieve|fetch)\b.*",
    r"(?:we(?:'re| are)|(?:this|the|our)(?: requested)? (?:site|website|page|service|server|content|resource|link|application|system|request)(?: \w+)*? (?:is|was|has been|are|cannot be|can't be|could not be|couldn't be)) (?:currently |temporarily )?(?:unavailable|not available|offline|down|blocked|closed|moved|removed|expired|broken|loaded|displayed|processed|completed|under maintenance|down for maintenance|undergoing maintenance)\b.*",
    r"(?:your|the|this) (?:request|connection|access|browser|account|ip(?: address)?|link) (?:has been |was |is |has |could not be )(?:blocked|denied|refused|rejected|expired|timed out|suspended|not supported|unsupported|no longer supported|outdated|processed)\b.*",
    r"you (?:do not|don't|are not|have not|must) (?:have (?:permission|access)|authori[sz]ed|allowed|permitted|be (?:logged|signed) in)\b.*|(?:connection|request|operation|gateway|session) (?:timed out|refused|reset|expired|failed)\b.*",
    r"(?:please )?(?:verify|confirm|prove) (?:that )?you are (?:a )?(?:human|not a robot)\b.*|(?:complete|solve) the captcha\b.*|unusual traffic\b.*",
]
_EXCLAIMS = re.compile(r"(?:sorry|oops|whoops|uh[ -]oh|apologies|error|attention|warning|notice)[!.:… ]*")
MAYBE = re.compile("(?:" + "|".join(_MAYBE) + ")")
#: What longer error messages say besides, sentence by sentence.
DETAILS = re.compile(
    r"(?:not found|forbidden|internal server error|bad gateway|proxy error|service unavailable) the (?:requested|server|proxy|web ?server) .*|the requested (?:url|page|resource|file|address)(?: \S+)? (?:was|could|is) not .*"
    r"|additionally, a 0 .* error was encountered while trying to use an errordocument to handle the request\.?|the server encountered an (?:internal error|unexpected condition|internal error or misconfiguration).*"
    r"|(?:please )?contact the (?:server|site|web ?site|system) (?:administrator|owner)\b.*|more information about this error (?:may|can) be (?:available|found) in the server error log\.?|the proxy server (?:received an invalid|could not handle the).*|reason: .*"
    r"|you (?:don't|do not) have permission to access .*|the server is (?:temporarily|currently) unable to (?:service|handle) your request.*|.{0,40}server at \S+ port 0\.?|#0 .*|(?:at )?[\w.$<>]+\(.*:0\)?(?: .*)?|file \S+ line 0, in .*|(?:stack trace|caused by): .*"
)
_sentence = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])\s*|\s+(?=#0 |at [\w.$<>]+\(|file \S+ line 0)")

# Asking for scripts, a word for scripts and a word for turning them on, by language.
_SCRIPTS = re.compile(r"\bjava ?script\b|javascript|\bjs\b|\bscripting\b|\bscripts?\b|\bskripte?n?\b|скрипт|スクリプト|脚本|자바스크립트|스크립트")
_ENABLE = re.compile(
    r"\b(?:enable|allow|activate|turn(?:ed)? on|switch(?:ed)? on|enabled|require[sd]?|needs? javascript|must have)\b|aktivier|einschalt|erlaub|zulass|benötig|\bactive[rzs]?\b|autoris|nécessite|habilit|permit[ae]|necesita|requiere|ative\b|attiva|abilita|consent[ai]"
    r"|включите|включить|разрешите|необходим|требуется|włącz|zezwól|aktywuj|wymaga|etkinleştir|açın|gerekli|bật |cho phép|有効|必要|オンに|許可|启用|打开|开启|允许|需要|활성화|허용|켜|필요"
)
#: Who is asked, or for what: the rest of such a notice.
_ASK = re.compile(
    r"\b(?:please|kindly|you (?:need|must|have)|to go on|to continue|it seems you|your browser|browser settings|reload|view this|see the)\b|\bbitte\b|sie müssen|veuillez|merci d|\bdebe\b|por favor|navegador|esta página|пожалуйста|браузер|для работы|страниц"
    r"|per favore|browser|proszę|lütfen|vui lòng|ください|ページ|必要です|请|您|浏览|세요|주십시오|페이지|cette page|pour continuer"
)
_SKILLS = re.compile(r"\bskills?\b|\bcourses?\b|\bteach\b|\blisted\b|\bcounts? as\b")

_opens = re.compile(r"[{<%\[$]|\*\||@@|__|&lt;%")
_url = re.compile(r"(?:https?://|www\.)\S+|\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+|(?<![\w/])(?:/[\w.~-]+){2,}/?|\b[a-z]:\\[\w\\.~-]+|\b(?:\d{1,3}\.){3}\d{1,3}\b", re.I)
_date = re.compile(r"\b\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b")
_number = re.compile(r"\d+(?:[.,]\d+)*")
_space = re.compile(r"\s+")
_numbered = re.compile(r"(?:\s[#(]?0\)?)+$")
#: The name of the site at the end of a page title.
_site = re.compile(r"\s+[–—|-]\s+[\w-]+(?:\.[\w-]+)+\s*$")
_ends = re.compile(r"^[\s|•·*\"“”'«»-]+|[\s|•·*\"“”'«»-]+$")


def masked(form: str) -> str:
    """Lower case, with addresses, dates and numbers masked and plain spacing."""
    s = _number.sub("0", _date.sub("0", _url.sub("@", form)))
    return _space.sub(" ", s).strip().lower()


def _literals(parsed) -> frozenset[str] | None:
    """Of a parsed rule, strings of which every match holds at least one; None if it may hold none. Digits are masked in what rules see, so they are in none."""
    best: frozenset[str] | None = None
    run = ""

    def offer(found: frozenset[str] | None) -> None:
        nonlocal best
        if found and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    for op, arg in [*parsed, (None, None)]:
        if op is _rules.LITERAL and not chr(arg).isdigit() and chr(arg) != "@":
            run += chr(arg)
            continue
        offer(frozenset({run}) if run else None)
        run = ""
        if op is _rules.SUBPATTERN:
            offer(_literals(arg[3]))
        elif op is _rules.BRANCH:
            sets = [_literals(b) for b in arg[1]]
            offer(None if None in sets else frozenset().union(*sets))
        elif op in (_rules.MAX_REPEAT, _rules.MIN_REPEAT) and arg[0] > 0:
            found = _literals(arg[2])
            offer(found and frozenset(w * arg[0] for w in found) if len(arg[2]) == 1 and arg[2][0][0] is _rules.LITERAL else found)
    return best


@functools.cache
def _quick() -> ahocorasick.Automaton:
    """Strings of which every text that some rule matches holds one, taken from the rules themselves."""
    words = {w for w in LATIN_FILLER if len(w) > 3}
    for rule in (FILLER, MAYBE_FILLER, ERRORS, MAYBE, _SCRIPTS):
        words |= _literals(_rules.parse(rule.pattern)) or frozenset()
    a = ahocorasick.Automaton()
    for w in words:
        if not any(v != w and v in w for v in words):
            a.add_word(w, True)
    a.make_automaton()
    return a


def _most(parts: list[str], rule: Callable[[str], object]) -> bool:
    """Whether a rule holds for more than half of the parts; it is not asked further once that is out of reach."""
    misses = 0
    for p in parts:
        misses += not rule(p)
        if 2 * misses >= len(parts):
            return False
    return bool(parts)


def whole(text: str) -> str:
    """"placeholder", "filler", "message", "scripts", one of the UNSURE kinds, or "" of a text. The text is in its one form."""
    if _opens.search(text) and PLACEHOLDER.search(text):
        return "placeholder"
    if next(_quick().iter(" ".join(text.lower().split())), None) is None:
        return ""
    bare = _ends.sub("", masked(_site.sub("", text)))
    parts = [q.rstrip(" .!…:") for q in re.split(r"\s*[|]\s*", bare) if q]
    if parts and all(FILLER.fullmatch(p) or FILLER.fullmatch(_numbered.sub("", p)) for p in parts):
        return "filler"
    words = re.findall(r"[^\W\d_]+", bare)
    latin = sum(w in LATIN_FILLER for w in words)
    if words and latin >= 0.8 * len(words) and (len(words) > 3 or "lorem" in words or "ipsum" in words) and any(len(w) > 3 and w in LATIN_FILLER for w in words):
        return "filler"
    if ERRORS.fullmatch(bare):
        return "message"
    said = [p for p in _sentence.split(bare) if p]
    if len(said) > 1 and _most(said, lambda p: ERRORS.fullmatch(p) or DETAILS.fullmatch(p)) and any(ERRORS.fullmatch(p) for p in said):
        return "message"
    if _SCRIPTS.search(bare) and _ENABLE.search(bare) and not _SKILLS.search(bare):
        # a notice is about scripts, or about how to turn them on, in most of its sentences
        if _most(said, lambda p: sum(r.search(p) is not None for r in (_SCRIPTS, _ENABLE, _ASK)) > 1):
            return "scripts" if any(_SCRIPTS.search(p) and _ASK.search(p) for p in said) else "scripts?"
    if parts and all(MAYBE_FILLER.fullmatch(p) for p in parts):
        return "filler?"
    said = [p for p in said if not _EXCLAIMS.fullmatch(p)]
    if _most(said, lambda p: MAYBE.fullmatch(p.rstrip(".!…。 ")) or ERRORS.fullmatch(p) or DETAILS.fullmatch(p)):
        return "message?"
    return ""


def _classify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    form = rewriter().form
    for f in frames:
        kinds = [whole(form(t)) for t in f["value"]]
        yield f.drop(columns="value").assign(kind=kinds)[[k != "" for k in kinds]]


def masked_hash(value: Column) -> list[Column]:
    """Two hashes of a text in lower case with addresses, dates and numbers masked, computed in the JVM."""
    v = F.lower(value)
    # no group is repeated: the JVM would match a long one by recursion
    v = F.when(v.rlike(r"[/@\\]"), F.regexp_replace(v, r"(?:https?://|www\.)\S+|[\w.+-]+@[\w-]+\.[\w.-]+|/[\w.~-]+/[\w./~-]*|\b[a-z]:\\[\w\\.~-]+", "@")).otherwise(v)
    v = F.regexp_replace(v, r"[0-9][0-9.,:/-]*", "0")
    v = F.trim(F.regexp_replace(v, r"\s+", " "))
    return [F.xxhash64(v).alias("h1"), F.xxhash64(v, F.lit(1)).alias("h2")]


def _with(rows: DataFrame, found: DataFrame, on: list[str], most_broadcast: int) -> DataFrame:
    """rows joined with a table of one row per key. A key that a third of all rows have is no single task: the table is broadcast if it is small, else rows are spread over parts."""
    if found.count() <= most_broadcast:
        return rows.join(F.broadcast(found), on)
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("doc_id", "node_id"), F.lit(SALTS)).cast("int"))
    return rows.join(found.withColumn("__part", parts), [*on, "__part"]).drop("__part")


def residue(texts: DataFrame, least_sources: dict[str, int] = LEAST_SOURCES, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The rows of ``texts`` (doc_id, node_id, value, site) that are residue: doc_id, node_id, kind, sources, each node once.

    kind is placeholder, filler, message or scripts; sources is the number of sites over which the masked text recurs. Null and
    empty values are never cases; a null site counts as no source.
    """
    own = [F.xxhash64("value").alias("v1"), F.xxhash64("value", F.lit(1)).alias("v2")]
    # each distinct text is classified as it stands, whatever others share its mask; one that fills a third of the rows is one row of its partition before anything is shuffled
    kinds = texts.filter("value <> ''").select("value").distinct().select(*own, "value").mapInPandas(_classify, "v1 long, v2 long, kind string")
    rows = texts.filter("value <> ''").select("doc_id", "node_id", "site", "value", *own)
    found = _with(rows, cut(kinds), ["v1", "v2"], most_broadcast)
    found = cut(found.select("doc_id", "node_id", "site", "kind", *masked_hash(F.col("value"))))
    # exact: first each source once, then the sources of a text
    each = found.filter("site is not null").groupBy("h1", "h2", "kind", "site").agg(F.lit(1).alias("one")).groupBy("h1", "h2", "kind").agg(F.count(F.lit(1)).alias("sources"))
    sources = cut(found.select("h1", "h2", "kind").distinct().join(each, ["h1", "h2", "kind"], "left").withColumn("sources", F.coalesce("sources", F.lit(0).cast("long"))))
    least = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in least_sources.items() for x in pair]), F.col("kind")), F.lit(0))
    rows = _with(found.drop("site"), sources.filter(F.col("sources") >= least), ["h1", "h2", "kind"], most_broadcast).withColumn("kind", F.regexp_replace("kind", r"\?$", ""))
    return rows.select("doc_id", "node_id", "kind", "sources").dropDuplicates(["doc_id", "node_id"])


def residue_nodes(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, kind, sources of the text nodes of a node table that are residue; none are at any depth inside script, style, pre or code."""
    texts = nodes.filter("kind = 'text' and value is not null and not coalesce(only_whitespace, false)")
    found = residue(texts.select("doc_id", "node_id", "value", "site"))
    inside = nodes.filter("kind = 'element'").filter(F.lower("name").isin(*CODE_ELEMENTS)).select("doc_id", F.col("node_id").alias("a"), F.col("last_desc").alias("z"))
    code = found.select("doc_id", "node_id").join(inside, "doc_id").filter("a < node_id and node_id <= z").select("doc_id", "node_id")
    return found.join(code, ["doc_id", "node_id"], "left_anti")
