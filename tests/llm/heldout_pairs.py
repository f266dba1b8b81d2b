"""Pairs written without looking at the test tables: refusals, answers in other languages, sound values, cut and echoed answers."""

QUESTIONS = {
    "en": ["Where does my sister live now?", "What is the name of my dentist?", "Which book did I finish last week?"],
    "de": ["Wo wohnt meine Schwester jetzt?", "Wie heißt mein Zahnarzt?"],
    "fr": ["Où habite ma sœur maintenant ?", "Comment s'appelle mon dentiste ?"],
    "es": ["¿Dónde vive mi hermana ahora?", "¿Cómo se llama mi dentista?"],
}

REFUSALS = {
    "en": """
I'm afraid I can't share that.
No comment.
This isn't something I can comment on.
I regret that I lack the details required to respond.
As a language model, I am forbidden from discussing that topic.
I'm not permitted to disclose personal addresses.
Sorry, I won't be able to help you with that one.
I have no idea.
I do not recall that.
I could not locate anything on that subject.
That is beyond what I am able to tell you.
I must refuse to answer.
I'd prefer not to say.
Unfortunately there is no record of this in my notes.
I don't have access to that information.
My memory does not contain this.
We are unable to provide an answer at this time.
I cannot confirm or deny that.
Apologies, but I am not in a position to discuss this.
I haven't been told that, so I can't say.
I refuse to speculate.
It would not be appropriate for me to answer.
I'm going to have to decline.
I don't remember you mentioning it. Could you tell me more?
I really cannot say. Please try another question.
Nothing in my records mentions this.
I am not sure, and I would rather not guess.
I'm not comfortable sharing that.
I have been instructed not to reveal such details.
I wasn't able to find an answer to this.
There isn't enough information for me to answer.
I can't help with requests like this.
I never learned that.
This information is unavailable to me.
I simply don't know.
I am unable to assist.
I couldn't tell you.
That's not something I'm able to discuss.
I won't disclose this.
Sorry, no information available.
""",
    "de": """
Leider darf ich darüber keine Auskunft geben.
Ich weiß es leider nicht.
Kein Kommentar.
Dazu darf ich mich nicht äußern.
Das kann ich Ihnen nicht sagen.
Es tut mir leid, aber ich kann dir dabei nicht helfen.
Ich habe keine Ahnung.
Mir liegen dazu keine Daten vor.
Ich möchte diese Frage nicht beantworten.
Darüber habe ich keine Aufzeichnungen.
Ich muss die Antwort verweigern.
Das ist mir nicht bekannt.
Ich kann mich nicht daran erinnern.
Als KI darf ich solche Angaben nicht machen.
In meinen Notizen steht davon nichts.
Dazu kann ich leider nichts Genaues sagen.
Ich bin nicht befugt, darüber zu sprechen.
Es ist mir nicht möglich, das zu beantworten.
Ich lehne es ab, darauf zu antworten.
Hierzu fehlen mir die Informationen.
""",
    "fr": """
Je ne suis pas autorisé à en parler.
Je n'en sais rien.
Aucun commentaire.
Désolé, je ne peux pas vous donner cette information.
Je ne dispose pas de cette information.
Je refuse de répondre.
Il ne m'est pas possible de répondre à cela.
Je n'ai aucune idée.
Je ne me souviens pas de cela.
Mes notes n'en parlent pas.
Je préfère ne rien dire à ce sujet.
Malheureusement, je ne trouve aucune trace de cela.
En tant qu'IA, je ne peux pas divulguer ce genre de détails.
Je ne connais pas la réponse.
Je ne suis pas en mesure de vous aider.
Cela ne figure pas dans ma mémoire.
Je ne souhaite pas commenter.
Je ne sais pas, désolé.
Je n'ai pas accès à ces données.
Impossible pour moi de le dire.
""",
    "es": """
No estoy autorizado a hablar de eso.
No tengo ni idea.
Sin comentarios.
Lo siento, no puedo compartir esa información.
No dispongo de datos al respecto.
Me niego a responder.
No me es posible contestar.
No recuerdo eso.
No sé la respuesta.
Mis notas no dicen nada de eso.
Prefiero no decirlo.
Por desgracia, no encuentro ningún registro de eso.
Como modelo de lenguaje, no puedo revelar esos detalles.
No lo recuerdo, ¿puedes darme más pistas?
No estoy en condiciones de ayudarte.
Eso no consta en mi memoria.
No quiero especular.
La verdad es que no lo sé.
No tengo acceso a esos datos.
Me temo que no puedo contestar a eso.
""",
}

FOREIGN = """
de|Sie wohnt seit Mai in Lissabon.
de|Deine Schwester ist nach Porto gezogen.
de|Im letzten Gespräch hast du gesagt, dass sie umgezogen ist.
de|Er heißt Doktor Meier und hat seine Praxis in Köln.
de|Du hast das Buch am Freitag beendet.
fr|Elle habite Lisbonne depuis mai.
fr|Votre sœur vit maintenant à Porto.
fr|Il s'appelle Durand et travaille à Lyon.
fr|Vous avez fini ce livre vendredi.
fr|D'après nos échanges, elle a déménagé.
es|Ella vive en Lisboa desde mayo.
es|Tu hermana se mudó a Oporto.
es|Se llama García y trabaja en Madrid.
es|Terminaste ese libro el viernes.
es|Según lo que me contaste, ahora vive allí.
it|Abita a Lisbona da maggio.
it|Tua sorella si è trasferita a Porto.
it|Si chiama Rossi e lavora a Milano.
it|Hai finito questo libro venerdì.
it|Mi hai detto che adesso vive lì.
pt|Ela mora em Lisboa desde maio.
pt|A sua irmã mudou-se para o Porto.
pt|Ele chama-se Silva e trabalha em Braga.
pt|Você terminou esse livro na sexta-feira.
pt|Você me contou que ela não vive mais aqui.
nl|Ze woont sinds mei in Lissabon.
nl|Je zus is naar Porto verhuisd.
nl|Hij heet De Vries en werkt in Utrecht.
nl|Je hebt dat boek vrijdag uitgelezen.
nl|Volgens ons laatste gesprek woont ze daar nu.
sv|Hon bor i Lissabon sedan maj.
sv|Din syster har flyttat till Porto.
sv|Han heter Berg och arbetar i Uppsala.
sv|Du läste ut den boken i fredags.
da|Hun bor i Lissabon siden maj.
da|Din søster er flyttet til Porto.
da|Han hedder Jensen og arbejder i Odense.
da|Du blev færdig med bogen i fredags.
no|Hun har bodd i Lisboa siden mai.
no|Søsteren din har flyttet til Porto.
no|Du sa at hun ikke bor her lenger.
no|Han heter Hansen og jobber i Bergen.
fi|Hän on asunut Lissabonissa toukokuusta lähtien.
fi|Siskosi on muuttanut Portoon.
fi|Sanoit, että hän ei asu enää täällä.
fi|Hänen nimensä on Virtanen ja hän työskentelee Turussa.
pl|Ona mieszka w Lizbonie od maja.
pl|Twoja siostra przeprowadziła się do Porto.
pl|On nazywa się Kowalski i pracuje w Krakowie.
pl|Powiedziałeś, że już tam nie mieszka.
cs|Od května bydlí v Lisabonu.
cs|Tvoje sestra se přestěhovala do Porta.
cs|Jmenuje se Novák a pracuje v Brně.
cs|Říkal jsi, že už tam nebydlí.
sk|Od mája býva v Lisabone.
sk|Tvoja sestra sa presťahovala do Porta.
hu|Május óta Lisszabonban él.
hu|A nővéred Portóba költözött.
hu|Azt mondtad, hogy már nem lakik ott.
hu|Kovácsnak hívják, és Szegeden dolgozik.
ro|Ea locuiește la Lisabona din mai.
ro|Sora ta s-a mutat la Porto.
ro|Mi-ai spus că nu mai locuiește acolo.
ro|Se numește Popescu și lucrează la Cluj.
tr|Mayıstan beri Lizbon'da yaşıyor.
tr|Kız kardeşin Porto'ya taşındı.
tr|Artık orada yaşamadığını söyledin.
tr|Adı Yılmaz ve Bursa'da çalışıyor.
hr|Ona živi u Lisabonu od svibnja.
hr|Tvoja sestra se preselila u Porto.
id|Dia tinggal di Lisbon sejak Mei.
id|Kakakmu sudah pindah ke Porto.
id|Kamu bilang dia tidak tinggal di sana lagi.
vi|Cô ấy sống ở Lisbon từ tháng năm.
vi|Chị của bạn đã chuyển đến Porto.
ca|Viu a Lisboa des del maig.
ca|La teva germana s'ha traslladat a Porto.
lt|Ji gyvena Lisabonoje nuo gegužės.
lv|Viņa dzīvo Lisabonā kopš maija.
et|Ta elab alates maist Lissabonis.
sl|Od maja živi v Lizboni.
ru|Она живёт в Лиссабоне с мая.
ru|Твоя сестра переехала в Порту.
ru|Ты говорил, что она там больше не живёт.
uk|Вона живе в Лісабоні з травня.
uk|Твоя сестра переїхала до Порту.
bg|Тя живее в Лисабон от май.
el|Ζει στη Λισαβόνα από τον Μάιο.
el|Η αδελφή σου μετακόμισε στο Πόρτο.
ja|彼女は五月からリスボンに住んでいます。
ja|お姉さんはポルトに引っ越しました。
zh|她从五月起住在里斯本。
zh|你姐姐已经搬到波尔图了。
ko|그녀는 오월부터 리스본에 살고 있습니다.
ko|당신의 언니는 포르투로 이사했습니다.
ar|تعيش في لشبونة منذ مايو.
ar|انتقلت أختك إلى بورتو.
he|היא גרה בליסבון מאז מאי.
hi|वह मई से लिस्बन में रहती है।
th|เธออาศัยอยู่ในลิสบอนตั้งแต่เดือนพฤษภาคม
fa|او از ماه مه در لیسبون زندگی می‌کند.
"""

SOUND = """
Lisbon
The Lord of the Rings
La Casa de Papel
12 Rue de la Paix, Paris
At the corner of Main and 5th
Dr. Müller
St. Petersburg
Gone with the Wind
One Hundred Years of Solitude
To the Lighthouse
Die unendliche Geschichte
Der Herr der Ringe
Das Parfum
Le Petit Prince
Les Misérables
À la recherche du temps perdu
L'Étranger
Cien años de soledad
El amor en los tiempos del cólera
Don Quijote de la Mancha
Il nome della rosa
Os Maias
Rua Augusta 14, 1100-053 Lisboa
Calle de Alcalá 45, 28014 Madrid
Unter den Linden 77, 10117 Berlin
Am Markt 3, Bremen
Via dei Condotti 8, Roma
221B Baker Street
+49 30 901820
14 March 2023
3:45 pm
EUR 1,250.00
42
-7 °C
about 40 kg
every second Tuesday
twice a week
in the evening
near the old mill
a small red house near the lake
with her parents
next to the station
on the third floor
from May to September
the blue one
apples, pears and oranges
Anna, Ben and Carla
Anna und Ben
Anna et Benoît
Anna y Benito
milk, eggs, bread
- milk
red; green; blue
name: Anna; city: Lisbon
size: 42 | colour: black
Ludwig van Beethoven
Leonardo da Vinci
Charles de Gaulle
Vincent van Gogh
Simone de Beauvoir
Miguel de Cervantes
María del Carmen
Oscar de la Renta
Otto von Bismarck
Bank of America
University of Oxford
Universidad de Salamanca
Université de Genève
Freie Universität Berlin
Museo del Prado
Palais de la Découverte
Café de Flore
Rio de Janeiro
Santiago de Compostela
Frankfurt am Main
Stratford-upon-Avon
Bad Homburg vor der Höhe
Saint-Germain-en-Laye
The Hague
New York City
night train to Vienna
vegetable soup with rice
café au lait
crème brûlée
pasta al pesto
arroz con pollo
Schnitzel mit Pommes
gin and tonic
yes
No.
Yes, twice.
anna.k@example.org
https://example.org/a?b=1
ISBN 978-3-16-148410-0
AB-1234-CD
Windows 11 Pro
GNU Emacs 29
Beyond Good and Evil
東京
Москва
Αθήνα
She lives in Lisbon.
Since May it has been Lisbon.
You finished it on Friday.
His name is García.
Your sister's dog is called Rex.
In the session of 3 March you said Porto, and that still holds.
I could not confirm it at first, but it is Lisbon.
You said that you can't answer the phone on Mondays, so it is Tuesday at 5.
You never told Anna; the address is 14 High Street.
"""

CUT = """
Lisbon, Porto, and
She lives in
Your sister moved to Lisbon because she
The dentist is called
You finished it last week. It was the one about the
There were three of them:
1. milk
2.
- milk
- eggs
-
According to the session of 3 March, she has been living in (
It is Lisbon, which you mentioned when we
Sie wohnt seit Mai in
Elle habite à Lisbonne parce qu'elle
Ella vive en Lisboa porque
""".replace("1. milk\n2.", "1. milk\\n2.").replace("- milk\n- eggs\n-", "- milk\\n- eggs\\n-")

ECHOED = """
where does my sister live these days?
You asked: Where does my sister live now?
Where does my sister live now
Your question was: "Where does my sister live now?"
So, where does my sister live now?
Where is my sister living now?
Where does your sister live now?
"""


def lines(text: str) -> list[str]:
    return [x.replace("\\n", "\n") for x in text.strip().splitlines()]
