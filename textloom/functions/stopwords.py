"""Stop word lists of 13 languages.

English is a list of 33 words. The others are the lists of the Snowball project (https://snowballstem.org/), under
this notice:

    Copyright (c) 2001, Dr Martin Porter
    Copyright (c) 2004,2005, Richard Boulton
    Copyright (c) 2013, Yoshiki Shibukawa
    Copyright (c) 2006,2007,2009,2010,2011,2014-2019, Olly Betts
    All rights reserved.

    Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met:

      1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
         following disclaimer.
      2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
         following disclaimer in the documentation and/or other materials provided with the distribution.
      3. Neither the name of the Snowball project nor the names of its contributors may be used to endorse or promote
         products derived from this software without specific prior written permission.

    THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
    INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
    DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT OWNER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
    SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
    SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
    WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
    USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.

The four longest (Finnish, German, Italian, Spanish) are made of inflected pronouns and verbs: these come from stems and
endings, the other words are listed.
"""

from __future__ import annotations

from functools import lru_cache

# The word lists.

ENGLISH = """
a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will
with
"""

DANISH = """
og i jeg det at en den til er som på de med han af for ikke der var mig sig men et har om vi min havde ham hun nu over
da fra du ud sin dem os op man hans hvor eller hvad skal selv her alle vil blev kunne ind når være dog noget ville jo
deres efter ned skulle denne end dette mit også under have dig anden hende mine alt meget sit sine vor mod disse hvis
din nogle hos blive mange ad bliver hendes været thi jer sådan
"""

DUTCH = """
de en van ik te dat die in een hij het niet zijn is was op aan met als voor had er maar om hem dan zou of wat mijn men
dit zo door over ze zich bij ook tot je mij uit der daar haar naar heb hoe heeft hebben deze u want nog zal me zij nu
ge geen omdat iets worden toch al waren veel meer doen toen moet ben zonder kan hun dus alles onder ja eens hier wie
werd altijd doch wordt wezen kunnen ons zelf tegen na reeds wil kon niets uw iemand geweest andere
"""

FRENCH = """
au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me même mes moi mon ne nos notre
nous on ou par pas pour qu que qui sa se ses sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y étée
étées étant suis es êtes sont serai seras sera serons serez seront serais serait serions seriez seraient étais était
étions étiez étaient fus fut fûmes fûtes furent sois soit soyons soyez soient fusse fusses fussions fussiez fussent
ayant eu eue eues eus ai avons avez ont aurai aurons aurez auront aurais aurait aurions auriez auraient avais avait
aviez avaient eut eûmes eûtes eurent aie aies ait ayons ayez aient eusse eusses eût eussions eussiez eussent ceci cela
celà cet cette ici ils leurs quel quels quelle quelles sans soi
"""

HUNGARIAN = """
a ahogy ahol aki akik akkor alatt által általában amely amelyek amelyekben amelyeket amelyet amelynek ami amit amolyan
amíg amikor át abban ahhoz annak arra arról az azok azon azt azzal azért aztán azután azonban bár be belül benne cikk
cikkek cikkeket csak de e eddig egész egy egyes egyetlen egyéb egyik egyre ekkor el elég ellen elő először előtt első
én éppen ebben ehhez emilyen ennek erre ez ezt ezek ezen ezzel ezért és fel felé hanem hiszen hogy hogyan igen így
illetve ill. ill ilyen ilyenkor ison ismét itt jó jól jobban kell kellett keresztül keressünk ki kívül között közül
legalább lehet lehetett legyen lenne lenni lesz lett maga magát majd már más másik meg még mellett mert mely melyek mi
mit míg miért milyen mikor minden mindent mindenki mindig mint mintha mivel most nagy nagyobb nagyon ne néha nekem
neki nem néhány nélkül nincs olyan ott össze ő ők őket pedig persze rá s saját sem semmi sok sokat sokkal számára
szemben szerint szinte talán tehát teljes tovább továbbá több úgy ugyanis új újabb újra után utána utolsó vagy vagyis
valaki valami valamint való vagyok van vannak volt voltam voltak voltunk vissza vele viszont volna
"""

NORWEGIAN = """
og i jeg det at en et den til er som på de med han av ikke ikkje der så var meg seg men ett har om vi min mitt ha
hadde hun nå over da ved fra du ut sin dem oss opp man kan hans hvor eller hva skal selv sjøl her alle vil bli ble
blei blitt kunne inn når være kom noen noe ville dere deres kun ja etter ned skulle denne for deg si sine sitt mot å
meget hvorfor dette disse uten hvordan ingen din ditt blir samme hvilken hvilke sånn inni mellom vår hver hvem vors
hvis både bare enn fordi før mange også slik vært båe begge siden dykk dykkar dei deira deires deim di då eg ein eit
eitt elles honom hjå ho hoe henne hennar hennes hoss hossen ingi inkje korleis korso kva kvar kvarhelst kven kvi
kvifor me medan mi mine mykje no nokon noka nokor noko nokre sia sidan so somt somme um upp vere vore verte vort varte
vart
"""

PORTUGUESE = """
de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito
nos já eu também só pelo pela até isso ela entre depois sem mesmo aos seus quem nas me esse eles você essa num nem
suas meu às minha numa pelos elas qual nós lhe deles essas esses pelas este dele tu te vocês vos lhes meus minhas teu
tua teus tuas nosso nossa nossos nossas dela delas esta estes estas aquele aquela aqueles aquelas isto aquilo estou
está estamos estão estive esteve estivemos estiveram estava estávamos estavam estivera estivéramos esteja estejamos
estejam estivesse estivéssemos estivessem estiver estivermos estiverem hei há havemos hão houve houvemos houveram
houvera houvéramos haja hajamos hajam houvesse houvéssemos houvessem houver houvermos houverem houverei houverá
houveremos houverão houveria houveríamos houveriam sou somos são era éramos eram fui foi fomos foram fora fôramos seja
sejamos sejam fosse fôssemos fossem for formos forem serei será seremos serão seria seríamos seriam tenho tem temos
tém tinha tínhamos tinham tive teve tivemos tiveram tivera tivéramos tenha tenhamos tenham tivesse tivéssemos tivessem
tiver tivermos tiverem terei terá teremos terão teria teríamos teriam
"""

RUSSIAN = """
и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет
о из ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя
ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж
тогда кто этот того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее сейчас были куда зачем всех
никогда можно при наконец два об другой хоть после над больше тот через эти нас про всего них какая много разве три
эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между человек
сказал сказала сказать говорил кажется жизнь сегодня
"""

SWEDISH = """
och det att i en jag hon som han på den med var sig för så till är men ett om hade de av icke mig du henne då sin nu
har inte hans honom skulle hennes där min man ej vid kunde något från ut när efter upp vi dem vara vad över än dig kan
sina här ha mot alla under någon eller allt mycket sedan ju denna själv detta åt utan varit hur ingen mitt ni bli blev
oss din dessa några deras blir mina samma vilken er sådan vår blivit dess inom mellan sådant varför varje vilka ditt
vem vilket sitt sådana vart dina vars vårt våra ert era vilkas
"""

# The four that inflect: listed words, then (stems, endings).

FINNISH = """
olla olen olet on olemme olette ovat ole oli olisi olisit olisin olisimme olisitte olisivat olit olin olimme olitte
olivat ollut olleet en et ei emme ette eivät minä sinä hän me te he että ja jos koska kuin mutta niin sekä sillä tai
vaan vai vaikka kanssa mukaan noin poikki yli kun nyt itse se sen sitä siinä siitä siihen siltä sille siksi tuo nuo ne
nämä ketkä mitkä kuka ketä joka tätä tähän tuota tuohon jotka
"""
FINNISH_FORMS = (
    ("minu sinu", "n t a ssa sta un lla lta lle"),
    ("häne", "n t ssä stä en llä ltä lle"), ("hän", "tä"),
    ("mei tei hei", "dän dät tä ssä stä hin llä ltä lle"),
    ("tä", "mä män ssä stä llä ltä lle nä ksi"),
    ("tuo", "n ssa sta lla lta lle na ksi"),
    ("näi nii", "den tä ssä stä hin llä ltä lle nä ksi"),
    ("noi joi", "den ta ssa sta hin lla lta lle na ksi"),
    ("kene", "n t ssä stä en llä ltä lle nä ksi"),
    ("kei", "den tä ssä stä hin llä ltä lle nä ksi"),
    ("mi", "kä nkä tä ssä stä hin llä ltä lle nä ksi"),
    ("jo", "nka ta ssa sta hon lla lta lle na ksi"),
)

GERMAN = """
aber als also am an ander anderm andern anderr anders auch auf aus bei bin bis bist da damit dann der den des dem die
das daß dazu denn derer dessen dich dir du dies doch dort durch einig einmal er ihn ihm es etwas euer eure eurem euren
eurer eures für gegen gewesen hab habe haben hat hatte hatten hier hin hinter ich mich mir ihr ihnen euch im in indem
ins ist jetzt kann können könnte machen man mit muss musste nach nicht nichts noch nun nur ob oder ohne sehr sein
selbst sich sie sind so soll sollte sondern sonst über um und uns unse unsem unsen unser unses unter viel vom von vor
während war waren warst was weg weil weiter wenn werde werden wie wieder will wir wird wirst wo wollen wollte würde
würden zu zum zur zwar zwischen ein kein mein dein
"""
GERMAN_FORMS = (
    ("all ander dies einig jed jen manch solch welch ein kein mein dein ihr sein", "e em en er es"),
    ("der den des dem die", "selben"), ("der die das", "selbe"),
)

ITALIAN = """
i c l per tra contro io tu lui lei noi voi loro mio mia miei mie mi ti ci vi lo la li le gli ne il un uno una ma ed se
perché anche come dov dove che chi cui non più quale si tutto tutti a e o ho hai ha abbiamo avete hanno abbia abbiate
abbiano ebbi ebbe ebbero avesti avemmo aveste avendo sono sei è siamo siete sia siate siano ero eri era eravamo eravate
erano fui fosti fu fummo foste furono essendo faccio fai facciamo fanno faccia facciate facciano feci facesti fece
facemmo faceste fecero facendo sto stai sta stiamo stanno stia stiate stiano stavo stavi stava stavamo stavate stavano
stetti stesti stette stemmo steste stettero stando ad al di del da dal in nel con col coi su sul
"""
ITALIAN_FORMS = (
    ("a da de ne su", "llo i gli ll gl lla lle"),
    ("tu su", "o a oi e"), ("nostr vostr quant quest", "o a i e"), ("quell", "o a i e"), ("avut", "o a i e"),
    ("avr sar far star", "ò ai à emo ete anno ei esti ebbe emmo este ebbero"),
    ("av fac", "evo evi eva evamo evate evano"),
    ("ave fo face ste", "ssi sse ssimo ssero"),
)

SPANISH = """
de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre
cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante
ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella
estar estas algunas algo nosotros mi mis tú te ti tu tus ellas nosotras vosotros vosotras os esos esas estoy estás está
estamos estáis están esté estés estemos estéis estén estaba estabas estábamos estabais estaban estando estad he has ha
hemos habéis han habiendo soy eres es somos sois son era eras éramos erais eran fui fuiste fue fuimos fuisteis fueron
siendo sido tengo tienes tiene tenemos tenéis tienen teniendo tened
"""
SPANISH_FORMS = (
    ("mí", "o a os as"), ("tuy suy nuestr vuestr", "o a os as"), ("estad habid tenid", "o a os as"),
    ("estar habr ser tendr", "é ás á emos éis án ía ías íamos íais ían"),
    ("hab ten", "ía ías íamos íais ían"),
    ("hay se teng", "a as amos áis an"),
    ("estuv hub tuv", "e iste o imos isteis ieron iera ieras iéramos ierais ieran iese ieses iésemos ieseis iesen"),
    ("fu", "era eras éramos erais eran ese eses ésemos eseis esen"),
)

_LISTED = {
    "danish": DANISH, "dutch": DUTCH, "english": ENGLISH, "finnish": FINNISH, "french": FRENCH, "german": GERMAN, "hungarian": HUNGARIAN,
    "italian": ITALIAN, "norwegian": NORWEGIAN, "portuguese": PORTUGUESE, "russian": RUSSIAN, "spanish": SPANISH, "swedish": SWEDISH,
}
_FORMS = {"finnish": FINNISH_FORMS, "german": GERMAN_FORMS, "italian": ITALIAN_FORMS, "spanish": SPANISH_FORMS}
LANGUAGES = tuple(_LISTED)


@lru_cache(maxsize=None)
def stop_words(language: str) -> frozenset[str]:
    if language not in _LISTED:
        raise ValueError(f"no stop words for {language}")
    forms = (stem + ending for stems, endings in _FORMS.get(language, ()) for stem in stems.split() for ending in endings.split())
    return frozenset((*_LISTED[language].split(), *forms))
