"""Fixed values for judging answers: function words and letter marks by language, and word classes of refusals."""

# Frequent function words. Before the bar those that also stand in names and bare phrases
# (articles, prepositions, conjunctions, possessives), after it those that only sentences have.
FUNCTION_WORDS = {
    "en": "the a an of in on at to for with from by and or but as into over about than between near until since through before after his her your their my our its no all both each every some any more most other later ago now again | is are was were be been being am has have had do does did will would can could should may might must it you he she they we i me him them us that this these those which who what when where there not never yes then so because if still also yet how",
    "de": "der die das den dem des ein eine einen einem einer von vom zu zum zur für mit aus bei nach seit in im an am auf über unter vor hinter neben zwischen und oder bis sein seine ihre dein deine deinem deinen mein meine meiner als um ohne | ist sind war waren wird wurde hat haben hatte habe hast bist bin es er sie du ich wir sich nicht kein keine nichts dass wer wie wo wann was weil wenn aber noch schon auch nur jetzt dort hier dann man so dir mir mich dich ihm dies diese dieser welches welchen welchem welche welcher",
    "fr": "le la les l un une des du de d à au aux en dans sur sous avec sans pour par et ou vers chez depuis entre son sa ses mon ma mes ton ta tes leur notre votre nos vos selon après avant plus | est sont était étaient a ont avait as ai fut être avoir il elle on nous vous ils elles je j tu te t me m se s ce c cela ça cette cet ces qui que qu quel quelle ne n pas où quand comment parce mais y lui rien encore donc maintenant si",
    "es": "el la los las un una unos unas de del a al en con por para sin sobre desde hasta entre y e o su sus mi mis tu tus según más | es son era eran fue está están ser ha han he has había hay tiene tengo se lo le les me te nos que qué quién cuál cuándo cuando dónde donde cómo porque pero ya no sí ella él ellos usted tú yo nosotros esta este esto eso esa ese ahora también todavía nada si",
    "it": "il lo la i gli le l un uno una di del della dei delle dello da dal dalla dall a al alla ai in nel nella su sul sulla con per tra fra e ed o suo sua tuo tua mio mia dopo prima secondo ultima | è sono era erano essere ha hanno aveva hai ho si ci mi ti vi che chi quale non più lui lei loro io tu noi voi quando dove perché ma come adesso ora già anche questo questa quello quella stato stata se ne",
    "pt": "o a os as um uma de do da dos das em no na nos nas ao à para por pelo pela com sem sobre desde até entre e ou seu sua teu tua meu minha segundo mais | é são era foi foram está estão tem têm tinha ser ele ela eles elas você eu tu nós se que quem qual não nem já quando onde porque mas como agora isto isso esta este essa esse também lhe me te ainda",
    "nl": "de het een van in op aan naar voor met uit bij door over tot sinds tussen en of zijn haar mijn jouw volgens zonder | is was waren wordt heeft hebben had heb hij ze zij ik jij je u wij we die dat dit deze er niet geen niets nog al om als toen omdat maar ook nu daar hier waar wat wie hoe dan te",
    "sv": "en ett den det de i på av till från med för om vid under över efter mellan och eller sedan sin sitt din ditt min mitt | är var har hade blev han hon jag du vi ni dem som inte att nu där här när men också kan ska vill sig",
    "da": "en et den det de i på af til fra med for om ved under over efter mellem og eller siden sin sit din dit min mit | er var har havde blev han hun jeg du vi som ikke at nu der her når men også kan skal vil sig",
    "no": "en et den det de i på av til fra med for om ved under over etter mellom og eller siden sin sitt din ditt min mitt | er var har hadde ble han hun jeg du vi som ikke at nå der her når men også kan skal vil seg",
    "fi": "ja tai sekä kanssa ennen jälkeen lähtien asti | on ovat oli olivat hän he minä sinä se ne että joka ei en et enää myös kun mutta jo nyt siellä täällä ole ollut hänen",
    "pl": "w we z ze na do od u o i oraz lub dla po przed przez za pod nad | jest są był była było ma mają się nie już że on ona oni ja ty to ten ta który która gdzie kiedy ale jak tam tu jego jej twoja twój",
    "cs": "v ve z ze na do od u o a i nebo pro po před přes za pod nad | je jsou byl byla má mají se si ne už že on ona oni já ty to ten ta který která kde kdy ale jak tam tady jeho její tvoje tvůj jsi nyní",
    "sk": "v vo z zo na do od u o a i alebo pre po pred cez za | je sú bol bola má majú sa si nie už že on ona oni ja ty to ten ta ktorý ktorá kde kedy ale ako tam tu jeho jej tvoja tvoj",
    "hu": "a az egy és vagy óta után előtt között alatt | van vannak volt hogy nem ő ők én te ez azt már még is meg mert de most ott itt hol mikor",
    "ro": "de la în din pe cu pentru prin spre și sau un o unui unei al ale lui | este sunt era au a fost ea el ei eu tu se s mi ți că nu mai când unde dar acum acolo care ta sa",
    "tr": "ve veya ile bir bu şu için gibi kadar beri sonra önce | var yok değil o ben sen biz da de ki ne mi çok artık olarak olan ama şimdi orada burada",
    "hr": "u na od do iz s sa za po kod i ili | je su bio bila ima se ne nije da on ona oni ja ti to taj koji koja gdje kada ali kako tamo sada tvoja tvoj već",
    "sl": "v na od do iz z s za po pri in ali | je so bil bila ima se ne ni da on ona oni jaz ti to ta ki kje kdaj pa kako tam zdaj tvoja že",
    "id": "di ke dari pada untuk dengan dan atau sejak sampai | adalah ada ini itu yang dia kamu saya kami mereka tidak bukan sudah akan bisa lagi juga karena tetapi sana sini",
    "vi": "ở từ đến của và hoặc với trong | là có đã đang sẽ không cô ấy anh chị tôi bạn này đó được cho rồi",
    "ca": "el la els les un una de del dels d a al en amb per des fins i o seva seu teva teu meva meu | és són era ha han hi va es s que no ja ella ell jo tu quan on perquè però com ara aquí",
    "lt": "ir ar nuo iki prie su | yra buvo jis ji aš tu kad ne nebe jau kur kai bet dabar ten čia savo",
    "lv": "un vai no līdz pie ar kopš | ir bija viņš viņa es tu ka ne nav jau kur kad bet tagad tur šeit",
    "et": "ja või alates kuni koos | on oli ta nad ma sa et ei enam juba kus kui aga nüüd seal siin",
}
# Letters and endings typical of a language; _ is the end of a word.
MARKS = {
    "en": "th ght_ ing_ wh oo ee sh ck", "de": "ß sch ung_ lich_ ä ö ü", "fr": "œ è ê ç eau_ aux_ tion_ é", "es": "ñ ción_ ó_ í", "it": "zione_ zz cch gli_ ato_ ata_ ò_ à_ ì", "pt": "ã õ ção_ nh lh ou_ ê",
    "nl": "ij aa oo ee uu ijk_ heid_", "sv": "å ä ö ade_ tt_", "da": "æ ø å ede_", "no": "ø æ å tte_", "fi": "ää yö ssa_ ssä_ sta_ lla_ een_ oon_ kk uu", "pl": "ł ą ę ż ź ś ć ń cz sz",
    "cs": "ř ů ě š č ž ý_", "sk": "ľ ť ď ô č š ž ý_", "hu": "ő ű sz gy cs á ó", "ro": "ț ș ă î ește_", "tr": "ğ ı ş ü_ yor_ dı_ ç", "hr": "đ č ć š ž ije", "sl": "č š ž iv", "id": "ng_ kan_ ku_ mu_ nya_",
    "vi": "ơ ư ạ ả ấ ầ ẩ ộ ớ ờ ị ọ ụ ế ệ ề ể ố ồ ă", "ca": "ç l·l és_ eix à_", "lt": "ė ų ū į č š ž oje_", "lv": "ā ē ī ū ķ ļ ņ ģ", "et": "õ ä ö ü st_ is_ ab_",
}
# Scripts that have no words in common with the Latin one.
SCRIPTS = {
    "cyrillic": "Ѐ-ԯ", "greek": "Ͱ-Ͽἀ-῿", "hebrew": "֐-׿", "arabic": "؀-ۿݐ-ݿ", "devanagari": "ऀ-ॿ", "bengali": "ঀ-৿",
    "tamil": "஀-௿", "thai": "฀-๿", "georgian": "Ⴀ-ჿ", "armenian": "԰-֏", "hangul": "ᄀ-ᇿ가-힯", "kana": "぀-ヿ", "han": "㐀-䶿一-鿿",
}
# Word classes of refusals; * stands for any ending. ME counts as the speaker only behind a preposition.
CLASSES = {
    "en": {
        "SELF": "i my we our", "ME": "me us", "NOT": "not t cannot unable never nothing no none unwilling forbidden prohibited impossible beyond outside barred",
        "TELL": "answer* say* tell* shar* help* assist* comment* discuss* disclos* reveal* provid* give giving respond* confirm* determin* guess* speculat* talk* offer* address* comply reply* stat* specif* elaborat* name",
        "KNOW": "know* recall* remember* aware sure certain find* locat* learn* see told", "INFO": "information info detail* data record* idea clue knowledge notes memory mention* evidence access answer*",
        "AVAIL": "available found known stored recorded mentioned", "UNAVAIL": "unavailable missing unknown", "LACK": "lack* miss*", "DECLINE": "declin* refus* refrain* abstain*", "POSS": "allowed permitted authorized authorised possible",
        "COURTESY": "sorry afraid please unfortunately regret* apolog* thank* assistant ai model language honest let feel free ask else anything glad happy try check consult contact another",
    },
    "de": {
        "SELF": "ich mir mich mein meine meinen meinem wir uns", "NOT": "nicht kein keine keinen keinem keinerlei nichts nie unmöglich",
        "TELL": "sag* beantwort* antwort* helf* mitteil* geb* auskunft äußer* verrat* nenn* teilen bestätig* spekulier* rat* preisgeb* weiterhelf* kommentar* sprech* mach*",
        "KNOWS": "weiß weiss kenne", "KNOW": "weiß weiss wissen kenn* erinner* bekannt find*", "INFO": "information* angaben angabe auskunft notizen aufzeichnung* daten detail* gedächtnis unterlagen ahnung zugriff antwort", "AVAIL": "vor vorhanden verfügbar",
        "UNAVAIL": "unbekannt", "LACK": "fehl*", "DECLINE": "verweiger* ablehn* lehne passen", "POSS": "möglich befugt berechtigt erlaubt gestattet imstande lage",
        "COURTESY": "leider entschuldigung bitte tut leid bedau* frag* gern gerne danke assistent ki sprachmodell ehrlich gesagt",
    },
    "fr": {
        "SELF": "je j m me mes mon ma moi nous nos", "NOT": "ne n pas aucune aucun rien impossible jamais",
        "TELL": "répond* dire dis aid* parl* communiqu* partag* divulgu* précis* comment* révél* fourn* donner confirm* devin* spécul*", "KNOW": "sais savoir connais souviens rappelle trouv* permet",
        "INFO": "information* renseignement* donnée* données notes mémoire idée détail* trace* mention* accès réponse", "AVAIL": "disponible* trouvé* connue", "UNAVAIL": "indisponible* inconnu*", "LACK": "manqu*", "DECLINE": "refus* décline abstien*", "POSS": "possible autorisé* permis mesure",
        "COURTESY": "désolé désolée malheureusement regrette excus* pardon merci demand* assistant ia modèle franc honnête plaît autre",
    },
    "es": {
        "SELF": "yo me mi mis puedo podría tengo dispongo prefiero encuentro debo quiero voy estoy consigo nosotros", "NOT": "no ninguna ningún nada imposible nunca sin",
        "TELL": "respond* decir* dec* ayud* compart* coment* habl* revel* divulg* confirm* proporcion* dar* contest* adivin* especul*", "KNOW": "saber* conocer recordar", "KNOWI": "sé recuerdo conozco",
        "INFO": "información informaciones dato* detalle* notas memoria registro* idea constancia acceso respuesta", "AVAIL": "disponible* consta encontrad*", "UNAVAIL": "desconocid*", "LACK": "falta* carezco", "DECLINE": "niego rechazo declino rehúso abstengo", "POSS": "posible permitido autorizado condiciones",
        "COURTESY": "siento perdón disculp* desgracia lamentablemente gracias pregunt* asistente ia modelo sincero sincera favor otra",
    },
}
# Templates of refusals as sequences of word classes; those marked ! only fit a clause of at most five words.
TEMPLATES = """
SELF NOT TELL
NOT SELF TELL
SELF NOT KNOW
NOT SELF KNOW
KNOW SELF NOT
SELF KNOWS NOT
NOT KNOWI
SELF NOT INFO
NOT SELF INFO
SELF INFO NOT
NOT INFO AVAIL
INFO NOT AVAIL
INFO UNAVAIL
SELF LACK INFO
LACK SELF INFO
SELF DECLINE
SELF NOT POSS
NOT SELF POSS
! NOT TELL
! NOT INFO
"""
