"""The labelled sample from which problem 10 learns: general abusive and harmless passages in six languages.

Where they come from: all passages and word lists were written from general knowledge of what abuse looks like online (insults,
threats, wishes of death, dehumanising of groups, degrading talk, sexual demands, and the slang for them) and of what is often
taken for it. No text of the data was used, and none of its settings (cards, branches, reviewers) occur here. Six stock phrases
that turned out to share five words in a row with a test document were taken out; tests/llm/test_abuse.py keeps it at none.

All texts are fixed values. LEXICON groups words of one meaning, so that a passage with one of them teaches about all; words of a
class are alternatives, not examples of usage. MAX_SAMPLE bounds the passages of either kind that the classifier takes.
"""

from __future__ import annotations

MAX_SAMPLE = 2000

LEXICON = {
    # nouns and adjectives that insult a person
    "insult": """
        idiot idiots moron morons imbecile imbeciles cretin cretins bastard bastards scumbag scumbags asshole assholes
        arsehole arseholes bitch bitches whore whores slut sluts skank wanker wankers tosser twat twats prick pricks cunt cunts
        dickhead dickheads dumbass dumbasses dipshit shithead shitheads motherfucker motherfuckers cocksucker cocksuckers
        fuckwit fuckface fucker fuckers douchebag douchebags jackass loser losers dimwit dimwits halfwit halfwits nitwit
        simpleton buffoon retard retards retarded faggot faggots fag fags dyke tranny nigger niggers kike kikes chink chinks paki
        spic raghead swine hag bimbo pervert creep freak lowlife braindead bellend knobhead minger slag slags cow crybaby
        connard connards connasse connasses conne salope salopes salaud salauds salopard pute putes encule encules abruti
        abrutis abrutie imbecile cretine debile debiles batard batards ordure ordures raclure pourriture bouffon bouffons
        tapette pede pedes pd gouine bougnoule youpin crevure crevures enfoire enfoires trouduc pouffiasse grognasse truie
        minable tare attarde attardee demeure
        idiota idiotas imbecil imbeciles estupido estupida estupidos tonto tonta gilipollas cabron cabrones cabrona pendejo
        pendeja pendejos puta putas puto zorra zorras perra perras guarra maricon maricones marica bollera subnormal
        subnormales retrasado retrasada malnacido malnacida mamon capullo cerdo cerda cretino sudaca payaso baboso
        desgraciado desgraciada culero huevon boludo pelotudo mongolo
        vollidiot vollidioten idioten trottel depp deppen schwachkopf dummkopf arschloch arschlocher arschgeige wichser
        hurensohn hurensohne hure huren schlampe schlampen fotze fotzen nutte nutten miststuck drecksau sau schwein schweine
        missgeburt missgeburten spast spasti mongo schwuchtel schwuchteln kanake kanaken neger penner versager pisser
        drecksack mistkerl zicke bastarde flachzange
        aptal aptallar salak salaklar gerizekali gerizekalilar ahmak serefsiz serefsizler orospu orospular pic picler pezevenk
        kahpe ibne ibneler gavat pust kopek kopekler esek okuz dangalak beyinsiz haysiyetsiz namussuz alcak kaltak surtuk yavsak
        soysuz dallama
        غبي غبيه اغبياء حمار حماره حمير كلب كلبه كلاب حقير حقيره احمق حمقاء عاهره شرموطه قحبه خنزير خنزيره خنازير سافل سافله
        وسخ وسخه قذر قذره تافه تافهه منحط نذل حيوان بهيمه معتوه متخلف متخلفه واطي ديوث لقيط فاجره ساقط ساقطه
    """,
    # people called animals, dirt or disease
    "vermin": """
        parasite parasites vermin cockroach cockroaches plague filth scum subhuman subhumans savages leeches maggots rats rat
        disease cancer trash garbage animals apes
        vermine parasites cafards ratas rats racaille dechets sauvages nuisibles cancrelats fleau sousmerdes
        rata ratas cucarachas cucaracha parasitos parasito plaga alimanas basura escoria salvajes gentuza bestias
        ungeziefer abschaum parasiten ratten kakerlaken schmarotzer untermenschen pack gesindel seuche dreckspack
        hasere hasereler bocek bocekler parazit parazitler mikrop mikroplar pislik yaratik
        حشرات حشره جرذان صراصير طفيليات قمامه زباله وباء جراثيم همج حثاله
    """,
    "belittling": """
        worthless useless pathetic filthy disgusting lazy ugly shitty fucking brainless spineless stinking miserable incompetent
        stupid dumb dirty fat smelly goddamn bloody vile rotten
        sale sales nul nulle degueulasse puant puante moche inutile stupide gros grosse
        asqueroso asquerosa inutil mugriento maldito maldita jodido sucio sucia apestoso repugnante patetico patetica
        dreckig dreckige dreckiger widerlich widerliche widerlicher nutzlos nutzlose nutzloser dumm dumme dummer hasslich fett
        hasslicher hassliche verdammter verfickte verfickter
        igrenc iskence yaramaz pis ucube aciz cirkin rezil
        مقرف مقرفه بشع بشعه فاشل فاشله عديم
    """,
    # acts of violence against people
    "violence": """
        kill strangle stab burn shoot beat drown hang slaughter choke murder gut behead smash crush cripple slit bury batter
        crever tuer egorger etrangler bruler buter massacrer demolir eventrer pendre
        matar quemar degollar estrangular matare romper reventar ahorcar apunalar destripar
        umbringen toten abstechen erwurgen verbrennen erschlagen aufschlitzen zusammenschlagen kaltmachen
        gebertecegim oldurecegim bogacagim kesecegim yakacagim dovecegim vuracagim parcalayacagim gebertirim oldururum keserim
        اقتلك ساقتلك اذبحك ساذبحك احرقك ساحرقك اضربك ساضربك اخنقك ساخنقك ادفنك سادفنك اكسر ساكسر
    """,
    "extermination": """
        exterminated gassed shot burned wiped burnt hanged eradicated deported slaughtered culled sterilised sterilized stoned
        exterminarlos quemarlos matarlos fusilarlos deportarlos eliminarlos exterminer eliminer gazer fusiller
        vergast ausgerottet erschossen ertranken verbrannt vernichtet abgeknallt aufgehangt
        yakmak oldurmek temizlemek asmak gebertmek
        حرقهم قتلهم ابادتهم طردهم سحقهم شنقهم
    """,
    # sexual body parts and acts, aimed at someone
    "sexual": """
        cock dick pussy tits boobs ass arse nudes titties nipples penis vagina butt
        fuck bang screw suck lick shag rape
        seins nichons chatte bite cul fesses foutre
        tetas tetitas pechos polla cono concha culo verga follar follarte
        titten bruste muschi schwanz arsch ficken
        memelerini memeleri memelerin gogus gogusleri gogusunu kalcani kalcalarini sikini
        صدرك نهديك جسدك عاريه عاري مؤخرتك نهودك مفاتنك
    """,
    "group": """
        migrants immigrants foreigners refugees gays lesbians cripples muslims jews christians arabs blacks whites women females
        africans gypsies asians mexicans homosexuals transsexuals
        etrangers immigres migrants refugies arabes noirs juifs musulmans homosexuels femmes roms
        inmigrantes extranjeros refugiados migrantes moros negros judios gitanos homosexuales mujeres
        auslander fluchtlinge migranten turken araber juden schwule zigeuner moslems frauen
        gocmenler multeciler yabancilar suriyeliler araplar yahudiler ermeniler kurtler kadinlar
        المهاجرون المهاجرين اللاجئون اللاجئين الاجانب اليهود النساء السود الغجر
    """,
}

ABUSIVE = """
you idiot
you are an idiot
you are such an idiot
you are all idiots
what an idiot you are
you are a stupid asshole and nobody likes you
you are nothing but a whore
you are nothing but trash
you are a disgusting pig
you fat pig
you are a fucking disgrace you moron
you complete moron
you absolute cunt
you stupid bitch
you dirty whore
you ugly bastard
you lying piece of shit
he is a worthless piece of shit
she is a stupid slut
she is a dirty whore
that stupid bitch
these morons
they are all bastards
shut up you idiot
shut the fuck up bitch
shut your filthy mouth
shut your ugly face
stop talking you brainless cow
listen you worthless idiot
go fuck yourself
go fuck yourself asshole
fuck you
fuck you bitch
fuck you and your family
fuck off
fuck off and die
screw you asshole
get lost you loser
kiss my ass you moron
eat shit
eat shit you bastard
suck my dick
son of a bitch
son of a whore
piece of shit
up yours asshole
go to hell you bastard
burn in hell you bitch
rot in hell
i hope you rot in hell
may you rot in hell you scumbag
i hope you die
i hope she dies slowly
i hope they all die
i hope you die in pain you bastard
i hope you get cancer
i hope your children get cancer
i hope you get run over by a bus
drop dead
drop dead you bitch
just die already
why don't you just die
kill yourself
go kill yourself
please kill yourself
kys
go hang yourself
go drown yourself
hang yourself and make everyone happy
do everyone a favour and die
do us all a favour and kill yourself
do the whole world a favor and drop dead
jump off a bridge
go jump off a bridge
go jump under a train
throw yourself out of the window
drink bleach
slit your wrists
nobody would miss you if you were dead
the world would be a better place without you
the world would be better off if you were dead
you should never have been born
your mother should have aborted you
your mother should have swallowed you
your parents must be ashamed of you
no wonder your father left
no wonder your wife left you
nobody will ever love you with that face
with a face like yours nobody will ever love you
you are so ugly that mirrors break
you do not deserve to live
you do not deserve to breathe
people like you do not deserve to live
people like you should be shot
people like you should not exist
someone like you should be locked up and beaten
you are a waste of oxygen
you are a waste of skin
what a waste of space you are
you have the brain of a goldfish
you have the brain of a chicken
he has the brains of a donkey
even a dog is smarter than you
even a monkey could do better than you
a monkey has more brains than you
a dead dog would be more useful than you
are you stupid or just retarded
how can anyone be so fucking stupid
only an idiot would believe that
only a moron would do that
whoever wrote this is an idiot
whoever did this is a bastard
you are too stupid to breathe
too stupid to tie your shoes
you stink like a pig
you smell like a toilet
you look like a fat pig
go back to your cave you ape
crawl back under your rock you worm
crawl back to the sewer
your mother is a whore
your sister is a slut
your whole family is scum
i fucked your mother
i will kill you
i am going to kill you
i'm gonna kill you
i swear i will kill you
i will kill you and your family
i will kill your children
i will hurt your children
i will find you and kill you
i will find out where you live
i know where you live
i know where you work and where you live
i know where your kids go to school
i will come to your house and beat you
i will wait for you outside and beat you
i will break your legs
i will break every bone in your body
i will break your neck
i will smash your face
i will knock your teeth out
i will cut your throat
i will slit your throat tonight
i will burn your house down
i will shoot you in the head
i will put a bullet in your head
i will stab you in your sleep
i will strangle you with my own hands
i will make you bleed
i will make you suffer
you will bleed for this
you will pay for this with your life
you will pay for this with blood
there will be blood
heads will roll and yours is first i promise
somebody is going to get hurt i promise
next time i will bring a gun
next time i bring a knife
you are dead
you are a dead man
you are dead meat
your days are numbered
watch your back
you had better watch your back
sleep with one eye open
enjoy your last night alive
tonight i come for you
it would be a shame if something happened to your family
it would be a pity if something happened to your children
shame if your house burned down
such a pretty house shame if it caught fire
accidents happen and brakes fail
pray that i never meet you in the dark
you won't wake up tomorrow
someone should shoot him
someone should burn that place down with all of them inside
they should all be shot
they should all be hanged
they should be put down like dogs
these people are animals
these people are vermin
these people are a disease
they are not human
they are subhuman
they are filthy animals and should be deported
they breed like rats
they breed like rabbits and live like pigs
they multiply like cockroaches
your kind is a plague
your kind are animals
your kind does not belong among humans
we do not want your kind here
we don't want your filthy kind here
your people should be wiped out
your people should have been exterminated
people of that race should be exterminated
people of that religion should be burned
all of them should be gassed
gas them all
shoot them all
burn them all
hang them all
drown them all at sea
kill them all
put them all in camps
send them all to the gas chambers
send them back in coffins
send them back where they came from
throw them all into the sea
go back to where you came from you savage
go back to your country you filthy rat
immigrants are parasites
immigrants are rats and should be drowned
foreigners are scum
refugees are vermin and should be shot
muslims are animals
muslims should be wiped out
jews are vermin
jews should be gassed
blacks are apes
blacks are lazy animals
arabs are savages
gypsies are thieving rats
gays are sick and should be burned
gays should be hanged
lesbians should be raped
christians are stupid and should be burned
the disabled are a burden and should have been drowned at birth
women are whores
women are stupid and belong in the kitchen
women are only good for sex
women are too dumb to drive
females should shut up and obey
no woman should be allowed to vote women are too stupid
a woman like that belongs in a brothel
she deserves to be raped
i hope you get raped
i will rape you
i want to fuck you
i want to fuck her
i want to fuck that woman so hard
i would fuck her all night
i would bang her
i would love to lick your pussy
i would love to suck those tits
i want to see you naked
i want you naked in my bed
i want to touch your body
let me touch your tits
let me see your ass
show me your tits
show me your tits and you get what you want
show me your pussy
send nudes
send me nudes
send me a photo of your dick
send me naked pictures of you
send me pictures of you without clothes
take your clothes off
take off your clothes for me
take it all off for me baby
get undressed for me
strip for me
spread your legs for me
open your legs
get on your knees
get on your knees and suck it
bend over
sit on my face
sit on my lap baby
come to my bed
sleep with me and you get the job
sleep with me or i refuse
what are you wearing under that dress sexy
are you wet
i get so hard when i hear your voice
my dick is hard for you
my dick is so hard baby
my cock is hard when i think of you
my pussy is wet for you
come and suck my cock
come here and fuck me
nice tits
nice ass baby
what a nice ass i would fuck that
idiot
fucking idiot
stupid moron
dirty bitch
lazy bastard
fucking bitch
asshole
tu es un idiot
tu es un connard
tu es une salope
tu es vraiment un abruti
tu es une grosse merde
tu n'es qu'une merde
tu n'es qu'un sale connard
t'es qu'une pute
vous etes un connard
vous etes des abrutis
vous etes une bande de connards
vous n'etes que des ordures
espece de connard
espece de salope
espece d'abruti
espece de sale pute
bande de connards
pauvre con
pauvre conne
gros con
sale con
sale pute
sale chien
sale arabe
sale juif
sale noir
ferme ta gueule
ferme ta gueule connard
ta gueule
ta gueule salope
va te faire foutre
va te faire enculer
va te faire voir connard
va crever
va mourir
va te pendre
va au diable connard
je t'emmerde
nique ta mere
nique ta race
fils de pute
fils de chien
ta mere la pute
casse toi pauvre con
creve salope
j'espere que tu vas crever
j'espere que vous allez tous crever
je vais te tuer
je vais vous tuer
je vais te crever
je vais tuer toute ta famille
je vais te casser la gueule
je vais te casser les jambes
je vais te retrouver
je vais te retrouver et te tuer
je vais bruler ta maison
je sais ou tu habites
tu vas le payer de ton sang
tu vas mourir
tu merites de mourir
tu ne merites pas de vivre
les gens comme toi ne meritent pas de vivre
le monde serait mieux sans toi
suicide toi
tue toi
les etrangers sont des parasites
les immigres sont de la vermine
les arabes sont des animaux
les juifs sont des rats
les femmes sont des putes
les homosexuels sont des malades il faut les bruler
il faut tous les tuer
il faut les exterminer
il faut les gazer
qu'on les brule tous
rentre dans ton pays sale rat
retourne dans ton pays
montre moi tes seins
montre tes seins
montre moi ton cul
envoie moi une photo de toi nue
envoie moi des photos de tes seins
deshabille toi
deshabille toi pour moi
ecarte les jambes
suce moi
suce ma bite
je veux te baiser
je veux coucher avec toi
je veux te voir nue
je vais te baiser
viens sur mes genoux cherie
eres un idiota
eres un imbecil
eres una puta
eres una basura
eres una mierda
eres un pedazo de mierda
eres un cerdo asqueroso
sois todos unos imbeciles
son unos idiotas
son todos unos hijos de puta
usted es un imbecil
hijo de puta
hijos de puta
hija de puta
hijo de perra
la puta que te pario
tu madre es una puta
puta madre que te pario
vete a la mierda
vete a la mierda cabron
vayanse a la mierda
vete al infierno
vete al carajo pendejo
que te jodan
que te den por culo
jodete
chinga tu madre
come mierda
pedazo de mierda
callate
callate la boca idiota
callate puta
callate perra
cierra la boca estupida
muerete
ojala te mueras
ojala se mueran todos
ojala te de cancer
te voy a matar
te voy a matar hijo de puta
los voy a matar
voy a matar a tu familia
voy a matarte
te voy a romper la cara
te voy a romper las piernas
te voy a partir la cara
te voy a encontrar
te voy a encontrar y te voy a matar
te voy a quemar vivo
voy a quemar tu casa
se donde vives
vas a morir
lo vas a pagar con sangre
mereces morir
no mereces vivir
la gente como tu no deberia existir
el mundo seria mejor sin ti
matate
suicidate
los inmigrantes son ratas
los extranjeros son basura
los moros son animales
los negros son monos
los judios son ratas
los gitanos son escoria
las mujeres son todas unas putas
las mujeres no sirven para nada
los maricones deberian morir
hay que matarlos a todos
hay que exterminarlos
hay que quemarlos vivos
hay que fusilarlos a todos
vuelve a tu pais
vuelve a tu pais rata asquerosa
muestrame tus tetas
ensename las tetas
mandame una foto desnuda
quiero verte desnuda
quitate la ropa
desnudate para mi
abre las piernas
chupame la polla
chupamela
quiero follarte
te quiero follar
quiero cogerte
sientate en mis piernas mi amor
du bist ein idiot
du bist ein arschloch
du bist eine schlampe
du bist ein wertloses stuck dreck
du bist ein stuck scheisse
du bist so dumm
du bist zu dumm zum atmen
du bist nichts wert
du dreckiges schwein
du dumme kuh
du dumme sau
du hurensohn
du blodes arschloch
du verdammter idiot
du missgeburt
ihr seid alle idioten
ihr seid abschaum
sie sind ein idiot
sie sind ein arschloch
so ein arschloch
diese idioten
dieser vollidiot
halt die fresse
halts maul
halt dein maul
halt dein dreckiges maul
verpiss dich
verpiss dich du schwein
fick dich
fick dich du hure
fick deine mutter
leck mich am arsch
leck mich du wichser
friss scheisse
geh sterben
geh zur holle
fahr zur holle
stirb
verrecke
verrecke du schwein
ich hoffe du stirbst
ich hoffe du verreckst
hang dich auf
bring dich um
spring von der brucke
die welt ware besser ohne dich
du verdienst es nicht zu leben
leute wie du sollten sterben
leute wie du gehoren weggesperrt
leute wie du gehoren erschossen
man hatte dich abtreiben sollen
ich bringe dich um
ich bring dich um
ich werde dich toten
ich werde dich umbringen
ich werde dich finden
ich werde dich finden und umbringen
ich mache dich kalt
ich stech dich ab
ich schlage dich tot
ich breche dir alle knochen
ich schlage dir die zahne aus
ich zunde dein haus an
ich weiss wo du wohnst
ich weiss wo deine kinder zur schule gehen
du bist tot
du wirst bluten
du wirst dafur bluten
das wirst du mit deinem leben bezahlen
auslander sind ungeziefer
fluchtlinge sind parasiten
diese leute sind tiere
juden gehoren vergast
die gehoren alle vergast
die gehoren alle erschossen
die sollte man alle aufhangen
die vermehren sich wie ratten
schwule gehoren verbrannt
frauen gehoren in die kuche
frauen sind zu dumm zum autofahren
geh zuruck in dein land
geh dahin wo du herkommst du ratte
zeig mir deine titten
zeig deine titten
zeig mir deinen arsch
schick mir nacktbilder
schick mir ein foto von deinen titten
zieh dich aus
zieh dich aus fur mich
mach die beine breit
blas mir einen
lutsch meinen schwanz
ich will dich ficken
ich will dich nackt sehen
setz dich auf meinen schoss susse
sen bir aptalsin
sen aptal misin
sen tam bir salaksin
sen bir pisliksin
sen bir hicsin
siz aptalsiniz
ne kadar salaksin
aptal herif
salak herif
serefsiz herif
pis herif
pis kopek
aptal kari
orospu cocugu
orospu cocuklari
it oglu it
pic kurusu
essoglu essek
kes sesini
kes sesini lan
kapa ceneni
kapa ceneni aptal
siktir git
siktir lan
siktir ol git
defol git serefsiz
cehenneme git
cehennemde yan
anani sikeyim
anani avradini
sikerim seni
allah belani versin
bok ye
geber
geber kopek
gebersin hepsi
umarim olursun
umarim gebersin
olmeyi hak ediyorsun
yasamayi hak etmiyorsun
senin gibiler yasamamali
dunya sensiz daha iyi olurdu
kendini oldur
kendini as
seni oldurecegim
seni gebertecegim
seni bulacagim
seni bulup oldurecegim
seni bicaklayacagim
seni yakacagim
seni bogacagim
aileni oldurecegim
evini yakacagim
bacaklarini kiracagim
agzini burnunu kiracagim
kafani kiracagim
kanini dokecegim
nerede oturdugunu biliyorum
bunun bedelini kaninla odeyeceksin
oldun sen
yabancilar hasere
multeciler parazit
gocmenler pislik
araplar hayvan
suriyeliler hayvan hepsini oldurmek lazim
hepsini yakmak lazim
hepsini asmak lazim
hepsini oldurmek gerek
kadinlar aptal
kadinin yeri mutfak
ulkene don pis kopek
geldigin yere don
memelerini goster
bana memelerini goster
bana ciplak fotografini gonder
ciplak fotografini at
soyun
benim icin soyun
bacaklarini ac
yala beni
seni sikmek istiyorum
seni ciplak gormek istiyorum
kucagima otur guzelim
sen ne anlarsin salak
salak misin sen
beyinsiz herif
ahlaksiz kopek
haddini bil kopek
bir maymun bile senden akilli
seni gebertirim
seni oldururum
seni bekleyip dovecegim
kapinda bekliyorum seni gebertecegim
gebersin pislikler
bunlar insan degil
bunlar hayvan
bunlari gebertmek lazim
hepsini surmek lazim
yok olun pislikler
goguslerini goster
gogusunu goster
ciplak resim at
yatagima gel
seninle yatmak istiyorum
انت غبي
انت حمار
انت كلب
انت حقير
انت حيوان
انت وسخ
انت قذر
انت لا شيء
انت اغبي انسان
انتم كلاب
انتم اغبياء
انتم حثاله
يا غبي
يا حمار
يا كلب
يا حقير
يا حيوان
يا قذر
يا عاهره
يا شرموطه
يا خنزير
يا ابن الكلب
يا ابن الحمار
يا ابن العاهره
يا ابن الشرموطه
يا اولاد الكلب
ابن كلب
امك عاهره
كس امك
كل خرا
اخرس
اخرس يا غبي
اخرس يا حيوان
اسكت يا كلب
انقلع يا حقير
تبا لك
تبا لك ايها الحقير
لعنه الله عليك
اذهب الي الجحيم
الله يلعنك
مت
اتمني ان تموت
اتمني لك الموت
اقتل نفسك
انتحر
لا تستحق الحياه
لا تستحق ان تعيش
امثالك يجب ان يموتوا
العالم افضل بدونك
ساقتلك
سوف اقتلك
سوف اقتلك انت وعائلتك
ساقتل اطفالك
ساذبحك
سوف اذبحك
ساحرق بيتك
ساكسر راسك
ساكسر عظامك
اعرف اين تسكن
سوف اجدك
ستدفع الثمن بدمك
ستموت
المهاجرون حشرات
اللاجئون قمامه
الاجانب كلاب
اليهود خنازير
النساء عاهرات
هؤلاء حيوانات
هؤلاء حشرات يجب سحقهم
يجب قتلهم جميعا
يجب حرقهم
يجب ابادتهم
ارجع الي بلدك يا كلب
ارني صدرك
ارسلي صوره صدرك
ارسلي لي صورك عاريه
ارسلي صورا عاريه
اخلعي ملابسك
اريد ان اراك عاريه
اريد ان انام معك
افتحي رجليك
تعالي الي سريري
انت لا تفهم
ليس عندك عقل
ما عندك عقل
انت قليل الادب
يا قليل الادب
يا عديم الشرف
يا ابن الحرام
ابن حرام
وجهك مثل القرد
القرد افهم منك
حتي الحمار افهم منك
ارجع الي الزريبه
راح اقتلك
رح اقتلك
ساجدك واقتلك
سانتظرك في الخارج واضربك
ساشرب من دمك
لن تعيش طويلا
موتوا جميعا
لا نريد امثالكم هنا
هؤلاء كلاب وقمامه
هؤلاء وباء يجب طردهم
اريد ان المس جسدك
اشتهي جسدك
اريد صورتك عاريه
يا حلوه اخلعي ملابسك
"""

HARMLESS = """
this damn computer
this stupid printer is broken again
the stupid thing crashed again and i lost everything
stupid website does not load
what a stupid rule
it was a stupid mistake of mine
i feel so stupid today
that was a dumb question sorry
the whole idea is idiotic
this fucking machine never works
the fucking internet is down again
fucking hell the train is late
oh fuck i forgot my keys
holy shit that was close
shit the battery is empty
what a piece of crap this phone is
what a piece of shit this car is
this piece of shit software crashed again
damn it
damn this weather
god damn it the door is stuck
what the hell is going on
why the hell does it take so long
hell of a week
the bloody bus never comes
bloody hell what a mess
the service was terrible
the food was disgusting and cold
i am very angry about the service
i am furious and want my money back
this is the worst company i ever dealt with
i hate mondays
i hate this song
i hate waiting
i will never buy here again
i will report you to the authorities
i will call my lawyer
i will send a complaint to your manager
i will kill the process and restart it
kill the process
kill the server and start it again
kill the job with signal nine
the parent process kills its children
orphan and zombie processes
the child process was killed
the slave database follows the master
master and slave
abort the transaction
execute the command
execute the script with root rights
the daemon dies at midnight
the disk is dead
dead letter queue
dump the table
burn the image to a disk
the process hangs
the program hangs and must be killed
strip the white space
strip the cable and screw it down
the screw is loose
male and female connectors
a stab in the dark
shoot a video
shoot the picture again
shoot from above
a screen shot
he got shot in the war
the battle killed thousands of people
the soldiers were shot
the film is about a murderer who strangles women
the police said the man was stabbed
the suspect was beaten and robbed
she was raped and reported it to the police
he was insulted and threatened
a report on hate speech and abuse
insults and threats are forbidden
do not insult other people
the user was banned for insults
messages with threats are deleted
the word idiot was removed
he called me an idiot and i was sad
calling someone a whore is an insult
racism is a crime
violence against women must end
jews were gassed in the camps during the war
people were burned as witches
slaves were beaten and hanged
refugees drowned in the sea
breast cancer
breast cancer screening
the patient has breast pain
breast feeding
rectal and vaginal examination
penis and vagina are words of anatomy
a blood test
blood pressure
there was blood on the bandage
he died of cancer
my mother died of cancer last year
my father died
the dog died
the dog bites
a dirty dog
pigs and cows on the farm
the pig farm
a monkey in the zoo
rats and cockroaches in the kitchen
pest control removed the rats
insects and parasites of plants
a plague of insects destroyed the harvest
take out the trash
garbage collection
trash folder
the trash is full
sexual health clinic
sex education in schools
sex male or female
sex m
sex f
a nude statue
naked eye
naked cable
cock and hen
a cock crows
dick is short for richard
ass is an old word for donkey
assess the class
the bass player
scunthorpe and essex
mrs cockburn and mr hancock
mr dickinson
immigrants and refugees are welcome
immigrants need a visa
muslims jews and christians live together
black and white
a black woman with a white child
women and men
gay marriage is legal
the disabled have rights
a lazy afternoon
a useless feature
that is pathetic
worthless coins
dirty hands
fat and sugar
you are right
you are welcome
you are the best
you are a good friend
you are so kind
you are not alone
you look great
you and your family
your mother is here
your family is welcome
i love you
i will find it
i will find you the right form
i will wait for you outside
i will come to your house tomorrow
i know where it is
i know where you can find it
i will send you a picture
send me a picture
send me the photos
send me the file
show me the way
show me the next page
take off your shoes
take off your hat for the picture
take off your glasses
sit down
come here
come to my place for dinner
open the door
get out of the car
watch your step
go back to the start page
go back
people like you make it worth it
people like us
people from all countries
the world would be a better place with more trees
i hope you are well
i hope your children get well soon
i hope it works
you will pay for it at the desk
it would be a shame to miss it
it would be a pity
they breed dogs
send them all a letter
send them back
burn calories
please wait
please call me back
please kill the job and start again
please shut the window
please go to the next page
go to bed
go to the doctor
go to the station and turn left
go to work by bus
come and see me
come here please
i want to go home
i want to see the manager
i want to know when it is done
i want my money back
i am going to call you
i am going to the doctor
i would love to help
i would love to come
i would like to know
i would like to see it
all of them were late
they should all be checked
they should be sent back
they are not ready
you should see a doctor
you should be able to log in
you should never share your password
you will be called
you will receive a letter
you do not need to pay
you are late
you are dead right
do us a favour and close the door
nobody would notice
why don't you just call
are you sure
are you there
what are you wearing to the wedding
how can anyone understand this
only a doctor can tell
next time i bring the original
next time i will call first
my days are numbered in this job
with one eye on the clock
no wonder the line is long
back to the start
the whole team is great
shut down the server
shut the door
stop talking and listen please
get lost in the city
that place is nice
cette imprimante de merde
putain de machine
putain il pleut encore
merde j'ai oublie mes cles
quel temps de merde
ce logiciel est nul
c'est nul
c'est stupide
quelle idee stupide
je suis en colere
je suis furieux
le service est nul
je vais porter plainte
je vais tuer le processus
je vais te retrouver devant la gare
je vais te montrer
je vais vous envoyer la photo
je sais ou c'est
cancer du sein
le sein gauche
sexe masculin
sexe feminin
tu es gentil
tu es mon ami
vous etes le bienvenu
vous etes un bon client
les etrangers ont besoin d'un visa
les femmes et les enfants
montre moi la page
envoie moi la photo
envoie moi des photos
sale temps
salle de bain
esta puta maquina
puta mierda de impresora
que mierda de tiempo
mierda me olvide las llaves
joder que frio
que idea tan estupida
estoy muy enojado
estoy harto de esperar
el servicio es malo
voy a poner una queja
voy a matar el proceso
te voy a llamar
te voy a encontrar en la estacion
te voy a mandar la foto
se donde esta
cancer de mama
el pecho izquierdo
sexo masculino
sexo femenino
eres muy amable
eres mi amigo
usted es muy amable
los inmigrantes necesitan visa
las mujeres y los ninos
muestrame la pagina
mandame la foto
mandame fotos
hay que esperar
scheiss drucker
so ein scheiss
scheisse ich habe den schlussel vergessen
verdammte maschine
verdammt noch mal
blode technik
so ein dummer fehler
das ist dumm
ich bin sauer
ich bin wutend
der service ist schlecht
ich werde mich beschweren
ich werde den prozess beenden
ich werde dich finden am bahnhof
ich werde dich anrufen
ich weiss wo es ist
brustkrebs
die linke brust
geschlecht mannlich
geschlecht weiblich
du bist nett
du bist mein freund
sie sind sehr freundlich
auslander brauchen ein visum
frauen und kinder
zeig mir die seite
zeig mir den weg
schick mir das foto
zieh die schuhe aus
bu lanet yazici
lanet olsun
kahretsin anahtarimi unuttum
aptal makine
aptalca bir hata
cok sacma
cok kizginim
hizmet cok kotu
sikayet edecegim
islemi sonlandiracagim
seni bulacagim istasyonda
seni arayacagim
nerede oldugunu biliyorum
meme kanseri
cinsiyet erkek
cinsiyet kadin
sen iyi bir insansin
sen cok iyisin
yabancilar vize almali
kadinlar ve cocuklar
bana sayfayi goster
bana fotografi gonder
kopek ve kedi
هذه الطابعه اللعينه
يا له من يوم سيئ
خطا غبي
فكره غبيه
انا غاضب
انا غاضب جدا
الخدمه سيئه
ساقدم شكوي
سوف اتصل بك
سوف اجدك في المحطه
سارسل لك الصوره
اعرف اين هو
سرطان الثدي
الجنس ذكر
الجنس انثي
انت طيب
انت صديقي
يا صديقي
يا سيدي
المهاجرون يحتاجون تاشيره
النساء والاطفال
ارني الصفحه
ارسلي الصوره
ارسلي لي الصور
كلب وقطه في البيت
يجب الانتظار
"""


def passages(text: str) -> list[str]:
    """The passages of one kind, at most MAX_SAMPLE."""
    return [x.strip() for x in text.strip().splitlines() if x.strip()][:MAX_SAMPLE]
