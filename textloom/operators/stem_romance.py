"""Spanish, French, Italian, Portuguese and Romanian stemmers, from the published Snowball definitions."""

from __future__ import annotations

import re
from functools import lru_cache

from .stemming import CACHE, after, cut, longest, regions, romance_rv

_V = "aeiouáéíóúü"


#: Fixed values of the definition.
_PRONOUNS = "me se sela selo selas selos la le lo las les los nos"
_R2 = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos"
_IC = "adora ador ación adoras adores aciones ante antes ancia ancias acion"
_STANDARD = f"{_R2} {_IC} logía logías ución uciones encia encias amente mente idad idades iva ivo ivas ivos"
_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos"
_VERB = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais "
    "iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir "
    "as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos en es éis emos"
)
_PLAIN = str.maketrans("áéíóú", "aeiou")


@lru_cache(maxsize=CACHE)
def spanish(word: str) -> str:
    w = word
    rv, (r1, r2) = romance_rv(w, _V), regions(w, _V)
    # 0: pronouns after a gerund or infinitive
    p = longest(w, _PRONOUNS, rv)
    if p:
        stem = w[: -len(p)]
        if len(stem) >= rv:
            accented = longest(stem, "iéndo ándo ár ér ír", rv)
            plain = longest(stem, "ando iendo ar er ir", rv)
            if accented:
                w = stem[: -len(accented)] + accented.translate(_PLAIN)
            elif plain or (stem.endswith("uyendo") and len(stem) - 5 >= rv):
                w = stem
    # 1
    before = w
    s = longest(w, _STANDARD)
    if s == "amente" and len(w) - 6 >= r1:
        w = w[:-6]
        t = longest(w, "iv os ic ad", r2)
        if t:
            w = w[: -len(t)]
            if t == "iv" and longest(w, "at", r2):
                w = w[:-2]
    elif s and s != "amente" and len(w) - len(s) >= r2:
        w = w[: -len(s)]
        if s in _IC.split():
            w = w[:-2] if longest(w, "ic", r2) else w
        elif s in ("logía", "logías"):
            w += "log"
        elif s in ("ución", "uciones"):
            w += "u"
        elif s in ("encia", "encias"):
            w += "ente"
        elif s == "mente":
            t = longest(w, "ante able ible", r2)
            w = w[: -len(t)] if t else w
        elif s in ("idad", "idades"):
            t = longest(w, "abil ic iv", r2)
            w = w[: -len(t)] if t else w
        elif s in ("iva", "ivo", "ivas", "ivos"):
            w = w[:-2] if longest(w, "at", r2) else w
    if w == before:
        # 2: verbs
        y = longest(w, _Y, rv)
        if y and w[: -len(y)].endswith("u"):
            w = w[: -len(y)]
        else:
            v = longest(w, _VERB, rv)
            if v:
                w = w[: -len(v)]
                if v in ("en", "es", "éis", "emos") and w.endswith("gu"):
                    w = w[:-1]
    # 3: what is left of a vowel
    s = longest(w, "os a o á í ó e é", rv)
    if s:
        w = w[: -len(s)]
        if s in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_PLAIN)


_FV = "aeiouyâàëéêèïîôûù"
#: Fixed values of the definition.
_F_ENDS = (
    "ance iqUe isme able iste eux ances iqUes ismes ables istes atrice ateur ation atrices ateurs ations logie logies usion ution usions utions ence ences "
    "ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments"
)
_F_I = (
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants "
    "isse issent isses issez issiez issions issons it"
)
_F_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez"
_F_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions"


def _french_regions(w: str) -> tuple[int, int, int]:
    r1, r2 = regions(w, _FV)
    if w.startswith(("par", "col", "tap")):
        rv = 3
    elif len(w) > 2 and w[0] in _FV and w[1] in _FV:
        rv = 3
    else:
        rv = after(w, f"[{_FV}]", 1)
    return rv, r1, r2


def _french_standard(w: str, rv: int, r1: int, r2: int) -> tuple[str, bool, bool]:
    """Step 1: the word, whether it changed, whether verb endings are tried all the same."""
    s = longest(w, _F_ENDS)
    if s is None:
        return w, False, True
    at = len(w) - len(s)
    head = w[:at]
    two = at >= r2
    if s in ("ance", "iqUe", "isme", "able", "iste", "eux", "ances", "iqUes", "ismes", "ables", "istes"):
        return (head, True, False) if two else (w, False, True)
    if s in ("atrice", "ateur", "ation", "atrices", "ateurs", "ations"):
        if not two:
            return w, False, True
        if head.endswith("ic"):
            head = head[:-2] if len(head) - 2 >= r2 else head[:-2] + "iqU"
        return head, True, False
    swap = {"logie": "log", "logies": "log", "usion": "u", "ution": "u", "usions": "u", "utions": "u", "ence": "ent", "ences": "ent"}
    if s in swap:
        return (head + swap[s], True, False) if two else (w, False, True)
    if s in ("ement", "ements"):
        if at < rv:
            return w, False, True
        if head.endswith("iv") and len(head) - 2 >= r2:
            head = head[:-2]
            if head.endswith("at") and len(head) - 2 >= r2:
                head = head[:-2]
        elif head.endswith("eus"):
            head = head[:-3] if len(head) - 3 >= r2 else head[:-1] + "x" if len(head) - 3 >= r1 else head
        elif head.endswith(("abl", "iqU")) and len(head) - 3 >= r2:
            head = head[:-3]
        elif head.endswith(("ièr", "Ièr")) and len(head) - 3 >= rv:
            head = head[:-3] + "i"
        return head, True, False
    if s in ("ité", "ités"):
        if not two:
            return w, False, True
        if head.endswith("abil"):
            head = head[:-4] if len(head) - 4 >= r2 else head[:-4] + "abl"
        elif head.endswith("ic"):
            head = head[:-2] if len(head) - 2 >= r2 else head[:-2] + "iqU"
        elif head.endswith("iv") and len(head) - 2 >= r2:
            head = head[:-2]
        return head, True, False
    if s in ("if", "ive", "ifs", "ives"):
        if not two:
            return w, False, True
        if head.endswith("at") and len(head) - 2 >= r2:
            head = head[:-2]
            if head.endswith("ic"):
                head = head[:-2] if len(head) - 2 >= r2 else head[:-2] + "iqU"
        return head, True, False
    if s == "eaux":
        return head + "eau", True, False
    if s == "aux":
        return (head + "al", True, False) if at >= r1 else (w, False, True)
    if s in ("euse", "euses"):
        return (head, True, False) if two else (head + "eux", True, False) if at >= r1 else (w, False, True)
    if s in ("issement", "issements"):
        return (head, True, False) if at >= r1 and head and head[-1] not in _FV else (w, False, True)
    if s in ("amment", "emment"):
        return (head + ("ant" if s == "amment" else "ent"), True, True) if at >= rv else (w, False, True)
    return (head, True, True) if at - 1 >= rv and head[-1:] in tuple(_FV) and head else (w, False, True)


@lru_cache(maxsize=CACHE)
def french(word: str) -> str:
    w = re.sub(r"qu", "qU", word)
    w = re.sub(f"(?<=[{_FV}])([ui])(?=[{_FV}])", lambda m: m[1].upper(), w)
    w = re.sub(f"(?<=[{_FV}])y|y(?=[{_FV}])", "Y", w)
    rv, r1, r2 = _french_regions(w)
    w, changed, verbs = _french_standard(w, rv, r1, r2)
    if verbs:
        was = w
        s = longest(w, _F_I, rv)
        if s and len(w) - len(s) - 1 >= rv and w[-len(s) - 1] not in _FV:
            w = w[: -len(s)]
        if w == was:
            s = longest(w, f"{_F_E} {_F_A} ions", rv)
            if s == "ions":
                w = w[:-4] if len(w) - 4 >= r2 else w
            elif s:
                w = w[: -len(s)]
                if s in _F_A.split() and w.endswith("e") and len(w) - 1 >= rv:
                    w = w[:-1]
        changed |= w != was
    if changed:
        w = w[:-1] + "i" if w.endswith("Y") else w[:-1] + "c" if w.endswith("ç") else w
    else:
        if w.endswith("s") and len(w) > 1 and w[-2] not in "aiouès":
            w = w[:-1]
        s = longest(w, "ion ier ière Ier Ière e ë", rv)
        if s == "ion":
            w = w[:-3] if len(w) - 3 >= r2 and w[-4:-3] in ("s", "t") and len(w) - 4 >= rv else w
        elif s in ("ier", "ière", "Ier", "Ière"):
            w = w[: -len(s)] + "i"
        elif s == "e":
            w = w[:-1]
        elif s == "ë" and w.endswith("guë"):
            w = w[:-1]
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    w = re.sub(f"[éè](?=[^{_FV}]+$)", "e", w)
    return w.lower()


_IV = "aeiouàèìòù"
#: Fixed values of the definition.
_I_PRONOUNS = (
    "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela "
    "vele veli velo vene"
)
_I_R2 = (
    "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti"
)
_I_AZIONE, _I_SWAP = "azione azioni atore atori", {"logia": "log", "logie": "log", "uzione": "u", "uzioni": "u", "usione": "u", "usioni": "u", "enza": "ente", "enze": "ente"}
_I_STANDARD = f"{_I_R2} {_I_AZIONE} {' '.join(_I_SWAP)} amento amenti imento imenti amente ità ivo ivi iva ive"
_I_VERB = (
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei "
    "eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste "
    "iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
)


def _then(w: str, endings: str, start: int) -> str:
    """w without one of the endings, if it is in the region."""
    s = longest(w, endings)
    return cut(w, s) if s and len(w) - len(s) >= start else w


def _italian_standard(w: str, rv: int, r1: int, r2: int) -> str | None:
    s = longest(w, _I_STANDARD)
    if s is None:
        return None
    head, at = cut(w, s), len(w) - len(s)
    if at < (rv if s in ("amento", "amenti", "imento", "imenti") else r1 if s == "amente" else r2):
        return None
    if s in _I_SWAP:
        return head + _I_SWAP[s]
    if s in _I_AZIONE.split():
        return _then(head, "ic", r2)
    if s == "amente":
        shorter = _then(head, "iv os ic abil", r2)
        return _then(shorter, "at", r2) if shorter != head and head.endswith("iv") else shorter
    if s == "ità":
        return _then(head, "abil ic iv", r2)
    if s in ("ivo", "ivi", "iva", "ive"):
        shorter = _then(head, "at", r2)
        return _then(shorter, "ic", r2) if shorter != head else head
    return head


@lru_cache(maxsize=CACHE)
def italian(word: str) -> str:
    w = word.translate(str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU")
    w = re.sub(f"(?<=[{_IV}])([ui])(?=[{_IV}])", lambda m: m[1].upper(), w)
    rv, (r1, r2) = romance_rv(w, _IV), regions(w, _IV)
    if p := longest(w, _I_PRONOUNS):
        stem = cut(w, p)
        if longest(stem, "ando endo", rv):
            w = stem
        elif longest(stem, "ar er ir", rv):
            w = stem + "e"
    standard = _italian_standard(w, rv, r1, r2)
    w = standard if standard is not None else cut(w, longest(w, _I_VERB, rv))
    if w[-1:] and w[-1] in "aeioàèìò" and len(w) > rv:
        w = w[:-1]
        if w.endswith("i") and len(w) > rv:
            w = w[:-1]
    if w.endswith(("ch", "gh")) and len(w) > rv:
        w = w[:-1]
    return w.replace("I", "i").replace("U", "u")


_PV = "aeiouáéíóúâêô"
#: Fixed values of the definition; a tilde stands after its vowel.
_P_R2 = (
    "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes "
    "ância"
)
_P_SWAP = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "ência": "ente", "ências": "ente"}
_P_STANDARD = f"{_P_R2} {' '.join(_P_SWAP)} amente mente idade idades iva ivo ivas ivos ira iras"
_P_VERB = (
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem "
    "irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes "
    "ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados "
    "idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou "
    "ira iras"
)


def _portuguese_standard(w: str, rv: int, r1: int, r2: int) -> str | None:
    s = longest(w, _P_STANDARD)
    if s is None:
        return None
    head, at = cut(w, s), len(w) - len(s)
    if s in ("ira", "iras"):
        return head + "ir" if at >= rv and head.endswith("e") else None
    if at < (r1 if s == "amente" else r2):
        return None
    if s in _P_SWAP:
        return head + _P_SWAP[s]
    if s == "amente":
        shorter = _then(head, "iv os ic ad", r2)
        return _then(shorter, "at", r2) if shorter != head and head.endswith("iv") else shorter
    if s == "mente":
        return _then(head, "ante avel ível", r2)
    if s in ("idade", "idades"):
        return _then(head, "abil ic iv", r2)
    return _then(head, "at", r2) if s in ("iva", "ivo", "ivas", "ivos") else head


@lru_cache(maxsize=CACHE)
def portuguese(word: str) -> str:
    w = word.replace("ã", "a~").replace("õ", "o~")
    rv, (r1, r2) = romance_rv(w, _PV), regions(w, _PV)
    standard = _portuguese_standard(w, rv, r1, r2)
    shorter = standard if standard is not None else cut(w, longest(w, _P_VERB, rv))
    if standard is not None or shorter != w:
        w = shorter[:-1] if shorter.endswith("ci") and len(shorter) - 1 >= rv else shorter
    else:
        w = _then(w, "os a i o á í ó", rv)
    if w[-1:] in ("e", "é", "ê"):
        if len(w) > rv:
            w = w[:-1]
            if w.endswith(("gu", "ci")) and len(w) > rv:
                w = w[:-1]
    elif w.endswith("ç"):
        w = w[:-1] + "c"
    return w.replace("a~", "ã").replace("o~", "õ")


_RV = "aeiouâîă"
#: Fixed values of the definition.
_R_FIRST = {
    "ul": "", "ului": "", "aua": "a", "ea": "e", "ele": "e", "elor": "e", "ii": "i", "iua": "i", "iei": "i", "iile": "i", "iilor": "i", "ilor": "i", "ile": "i",
    "atei": "at", "aţie": "aţi", "aţia": "aţi",
}
_R_COMBINED = {
    "abil": "abilitate abilitati abilităi abilităţi", "ibil": "ibilitate", "iv": "ivitate ivitati ivităi ivităţi",
    "ic": "icitate icitati icităi icităţi icator icatori iciv iciva icive icivi icivă ical icala icale icali icală",
    "at": "ativ ativa ative ativi ativă aţiune atoare ator atori ătoare ător ători", "it": "itiv itiva itive itivi itivă iţiune itoare itor itori",
}
_R_TO = {s: to for to, some in _R_COMBINED.items() for s in some.split()}
_R_IST = "ism isme ist ista iste isti istă işti"
_R_STANDARD = (
    "at ata ată ati ate ut uta ută uti ute it ita ită iti ite ic ica ice ici ică abil abila abile abili abilă ibil ibila ibile ibili ibilă oasa oasă oase os osi oşi "
    f"ant anta ante anti antă ator atori itate itati ităi ităţi iv iva ive ivi ivă iune iuni {_R_IST}"
)
_R_VERB = "ăm aţi em eţi im iţi âm âţi seşi serăm serăţi seră sei se sesem seseşi sese seserăm seserăţi seseră"
_R_VERB_AFTER = (
    "are ere ire âre ind ând indu ându eze ească ez ezi ează esc eşti eşte ăsc ăşti ăşte am ai au eam eai ea eaţi eau iam iai ia iaţi iau ui âi "
    + " ".join(v + e for v in "auiâ" for e in "şi răm răţi ră sem seşi se serăm serăţi seră".split())
)


@lru_cache(maxsize=CACHE)
def romanian(word: str) -> str:
    w = re.sub(f"(?<=[{_RV}])([ui])(?=[{_RV}])", lambda m: m[1].upper(), word)
    rv, (r1, r2) = romance_rv(w, _RV), regions(w, _RV)
    s = longest(w, " ".join(_R_FIRST))
    if s and len(w) - len(s) >= r1 and not (s == "ile" and cut(w, s).endswith("ab")):
        w = cut(w, s) + _R_FIRST[s]
    removed = False
    while (s := longest(w, " ".join(_R_TO))) and len(w) - len(s) >= r1:
        w, removed = cut(w, s) + _R_TO[s], True
    s = longest(w, _R_STANDARD)
    if s and len(w) - len(s) >= r2:
        if s not in ("iune", "iuni"):
            w, removed = cut(w, s) + ("ist" if s in _R_IST.split() else ""), True
        elif cut(w, s).endswith("ţ"):
            w, removed = cut(w, s)[:-1] + "t", True
    if not removed:
        s = longest(w, f"{_R_VERB} {_R_VERB_AFTER}", rv)
        before = w[-len(s) - 1 : -len(s)] if s and len(w) - len(s) > rv else ""
        if s and (s in _R_VERB.split() or (before and (before == "u" or before not in _RV))):
            w = cut(w, s)
    return _then(w, "a e i ie ă", rv).replace("I", "i").replace("U", "u")
