"""Abusive, hateful or sexually explicit language: a weighted lexicon matched by Aho-Corasick.

A text is folded first: compatibility forms, accents and homoglyphs of other scripts become plain letters, spaced
letters are joined, runs of a letter become one, and words with digits, symbols or a masking star are resolved
against the words of the lexicon; so are words whose letters were misread in scanning. The automaton then finds all
entries of the lexicon. An entry has a class, and most classes weigh nothing alone: a weight arises where classes
stand together in a slot pattern (who is meant, then what is said of them; a wish, then harm; an act, then a body
part), so a word in a plain or technical sense adds little. Words that make abuse a subject (called, annotated, slur,
detect, ...) and negations are the exceptions; they lower the weight of what stands in their reach.

Weights are per stretch of usual length: a longer sentence is scored in overlapping windows of that many words and its
worst window counts, as does the worst sentence of a document, so neither a long sentence nor a long document hides
anything. Text in quotation marks counts little: it is somebody else's.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

THRESHOLD = 2.0
#: Words of a window; windows of a long sentence overlap by half.
USUAL_WORDS = 30
QUOTED_SHARE = 0.3
#: Share that is left where a stretch is about abuse instead of abusive, by the number of words that say so.
SUBJECT_SHARE = (1.0, 0.5, 0.3, 0.15)

# Class, weight of an entry alone, entries. An entry is matched as whole words, folded.
LEXICON = """
insult 0.8: moron / morons / idiot / idiots / imbecile / imbeciles / cretin / cretins / halfwit / halfwits / dimwit / dimwits / dumbass / dumbasses / asshole / assholes / arsehole
insult 0.8: bastard / bastards / scumbag / scumbags / loser / losers / lowlife / lowlifes / jackass / jackasses / coward / cowards / degenerate / degenerates / retard / retards
insult 0.8: dickhead / dickheads / wanker / wankers / twat / motherfucker / shithead / simpleton / nitwit / dumbo / bitch / bitches / slut / sluts / whore / whores / douchebag / douche / tosser
insult 0.8: fuckwit / fucker / fuckers / bonehead / blockhead / dunce / dullard / pillock / numpty / ignoramus / pervert / psycho / creep / bimbo / skank / hag / prick / pricks / sod / git / buffoon / nutjob
insult 0.8: bullshitter / crybaby / swine / wretch / ingrate / subhuman scum / piece of shit / piece of crap / piece of garbage / piece of trash / sack of shit / pile of shit / waste of oxygen / waste of air
insult 0.8: schwein / arschloch / vollidiot / idiotin / versager / wichser / depp / trottel / hurensohn / missgeburt / dreckskerl / fotze / schlampe / penner / blodmann / dummkopf / miststuck / drecksau / spinner / hure
insult 0.8: connard / connards / connasse / abruti / abrutis / salaud / salope / batard / ordure / enfoire / pute / conne / encule / debile / bouffon / minable / cretine / raclure
insult 0.8: cabron / gilipollas / idiota / imbecil / cretino / payaso / puta / puto / hijo de puta / pendejo / mamon / capullo / maricon / zorra / subnormal / cabrona / tarado / imbeciles
insult 0.8: ordures / joke of a / absolute joke / absolute disgrace / a disgrace to / human garbage / human trash / bag of shit / shit for brains / dumb bitch / inbred / pieces of shit / waste of skin / idioten / arschlocher / salauds / ordures / hijos de puta / cabrones / stronzi
insult 0.8: stronzo / stronza / coglione / bastardo / troia / puttana / deficiente / cazzone / idioota / babaca / otario / cretina / vagabunda / klootzak / eikel / sukkel / hoer / kutwijf / idioot / kurwa / debil / skurwysyn / suka / сука / мразь / ублюдок / идиот / дебил / урод / тварь
insult 1.4: nigger / niggers / faggot / faggots / kike / kikes / chink / chinks / spic / spics / wetback / wetbacks / raghead / ragheads / tranny / trannies / gook / gooks / cunt / cunts / towelhead
weak 0.3: clown / clowns / fool / fools / parasite / parasites / fraud / frauds / pig / pigs / rat / snake / worm / cow / dog / liar / liars / cheat / jerk / weasel / monkey / donkey / ape / leech / freak / witch / nobody / joke / disgrace / failure / menteur / mentiroso / betruger / ratte / porc / cerdo / rata / chien / perro / maiale / hund / sau / pourri / inutil / con / bugiardo / clochard / basura / mierda / gusano / kuh / esel / affe / ziege / sau / ane / porco / burro / vaca / freaks
adj 0: stupid / pathetic / worthless / useless / brainless / spineless / filthy / disgusting / rotten / stinking / dirty / lying / idiotic / moronic / dumb / miserable / retarded / ignorant / gutless / vile / repulsive / revolting / ugly / fat / smelly / clueless / braindead / inbred / incompetent / subhuman / diseased
adj 0: absolute / complete / total / utter / damn / goddamn / bloody / crappy / fucking / shitty / fucked / bloated / useless little / stupid little / lazy / primitive / sick / little / old / mindless / pitiful / worthless little / slimy / cowardly / hopeless
adj 0: dummer / dumme / dummes / widerlicher / widerliche / erbarmlicher / erbarmliche / dreckiger / dreckige / elender / elende / blod / blode / bloder / verdammter / verdammte / beschissen / beschissene / hasslich / faul / primitiv / dreckigen
adj 0: pauvre / sale / sales / gros / grosse / pitoyable / stupide / bete / betes / degoutant / moche / feignant / foutu / asqueroso / asquerosa / miserable / maldito / maldita / estupido / estupida / feo / sucio / sucios / patetico / tonto / tontos / schifoso / stupido / brutto / inutile / domme / vieze / lelijke / глупый / тупой / тупая
harsh 0: bete / betes / tonto / tontos / tonta / tontas / dumme / dummer / dummes / stupide / idiot / hopeless / stupid / pathetic / worthless / brainless / spineless / disgusting / moronic / idiotic / dumb / braindead / repulsive / gutless / vile / inbred / subhuman / ugly / fucked / retarded / a joke / a disgrace / nothing but trash / blod / hasslich / erbarmlich / stupide / pitoyable / estupido / estupida / patetico / stupido
you 0: eres / sei un / sei una / bist / you / your / yours / yourself / yourselves / u / ur / ya / du / dich / dir / dein / deine / deinen / deinem / deiner / euch / tu / toi / te / ton / ta / tes / vous / votre / vos / ti / tus / usted / vosotros / sei / tuo / tua / voce / jij / je bent / jou / jouw / ты / тебя / твой / твоя
other 0: he / she / him / her / this guy / this man / this woman / that man / that woman / the author / this author / first author / second author / last author / the authors / the reviewer / this reviewer / first reviewer / second reviewer / reviewer two / reviewer 2 / the editor / my boss / my supervisor / er / sie / il / elle / ella / l auteur / der autor / el autor
thou 0: you / u / ya / thou / du / ihr / tu / toi / vous / eres / sei / voce / jij / ты / вы
thee 0: te / dir / dich / ti / t / euch / os
be 0: are / is / s / m / re / am / was / were / be / bist / ist / sind / seid / es / est / sont / etes / eres / es un / son / sois / sei un / e un / bent / zijn
whatkind 0: what kind of / which / what a / what an / such a / such an / you little / so ein / so eine / espece de / espece d / pedazo de
person 0: man / men / woman / girl / boy / guy / guys / lot / people / person / folks / kerl / mensch / weib / type / mec / tio / tipo
exclaim 0.5: nothing but / espece d / what a / such a / how can one / you little / so ein / so eine / only a / only an / even a / even an / any / espece de / bande de / pedazo de / quel / quelle / menudo / che / wat een / full stop / no doubt / like you / wie du / pareil / pareille / comme toi / como tu
iam 0: i am / i m / i was / i feel / we are / ich bin / je suis / soy
neg 0: not / n t / nobody is / no one is / never be / nicht / kein / keine / pas / no es / isn t / aren t / neither
insultcue 0.9: fucking / fuckin / shit / bullshit / crap / scheisse / merde / cazzo
abuse 2.0: drop dead / shut the fuck up / the fuck up / shut your mouth / halt die klappe / fuck the lot of you / you all suck / die slow / eat a dick / fuck you / screw you / fuck off / kiss my ass / kiss my arse / up your ass / go fuck yourself / eat shit / shove it up / damn you / son of a bitch / fuck yourself / suck my dick / suck my cock / bugger off / get fucked / rot in hell / burn in hell / die in a fire / go die / go kill yourself / you disgust me / i hate you all / kys
abuse 2.0: verpiss dich / halt die fresse / halt dein maul / halts maul / fick dich / leck mich am arsch / va te faire foutre / ta gueule / nique ta mere / va te faire / va crever / casse toi / vete al carajo / callate la boca / cierra la boca / vete a la mierda / que te jodan / me cago en / vai a farti fottere / vaffanculo / vai se foder / rot op / krijg kanker / иди нахуй / пошел нахуй / заткнись / spierdalaj
abuse 1.3: suck it / ferme la / tais toi / callate / get out of my / piss off / go to hell / get lost / shut up / your trap / trap shut / mouth shut / make me sick / make me puke / make me vomit / crawl back / under your rock / into your hole / waste of space / waste of money / waste of food / eat it / choke on it / stick it up / shove it / belongs in a cage / belongs in the gutter / belongs in the trash / belongs in jail / belong in a cage / belong in the trash / belong in the gutter / a heap of / what is wrong with you
abuse 1.3: so ein / niemand wurde dich / rapport de merde / sale menteur / puto informe / everybody knows it / half the field knows it / take your / nobody likes you / everyone hates you / you make me
brainof 0: the brain of / brain of a / the brains of / iq of / intelligence of / brain the size
dumber 0: dumber than / stupider than / uglier than / dumb as / stupid as / thick as / duller than
brains 0: more brains than / more sense than / more talent than / smarter than / a brain cell / brain cells / half a brain
hope 0: love to watch / love to see / like to watch / like to see / hope / wish / pray / hoffe / hoffentlich / espere / ojala / spero / j espere / would love to see / cannot wait for / somebody should make / want to see / want to watch
suffer 0: rot / die / burn / dead / get hit / get run over / run over / be hit / suffer / choke / drown / get cancer / cancer / starve / bleed / fall off / fall under / break your neck / verreckst / verrecke / verrecken / stirbst / creves / creve / mourir / mueras / muera / morir / muoia / crepare / crepa / get raped / be raped / crash / vanished / vanish / died / disappear / dropped dead / were gone / were run over / jump off / lose your
nobody 0: nobody / no one / not one of us / niemand / keiner / personne / nadie / nessuno / who / none of us / world
misses 0: miss / care / notice / mourn / cry / shed a tear / vermissen / weinen / manqueras / pleurera / llorar / echara de menos / better off / be better / better place
favour 2.2: us all a favour and disappear / us all a favor and disappear / us all a favour and jump / us all a favor and jump / us all a favour and die / us all a favor and die / the world a favour and die / the world a favor and die / the world a favor and disappear
menace 1.4: watch your back / i will find you / we will find you / i know who you are
menace 2.2: you will pay for this / you ll pay for this / you are dead meat / you re dead / coming for you / kill yourself / hang yourself / slit your wrists / you will regret being born / you are a dead man / sleep with one eye open / jump off a bridge / jump off a roof / end your life / ich bring dich um / je vais te tuer / te voy a matar / ti ammazzo / я тебя убью / ik maak je dood
know 0: know where / wissen wo / sais ou / savons ou / sabemos donde / se donde / so dove
lair 0: live / lives / sleep / sleeps / park / parks / work / works / stay / kids / family / children / wohnst / schlafst / habites / dors / vives / duermes / trabajas / abiti
weapon 0: brick / hammer / bullet / bomb / knife / gun / bullets / rope / acid / noose
letter 0: next letter / next parcel / next time / next mail / next email / next package / beg
will 0: will / ll / gonna / going to / should / ought to / want to / would love to / werde / sollte / vais / va / voy a / gehort / must / lets / let us / need to / have to / time to / someone / somebody / one of us / we / i d / faut / hay que / come and / find your
kill 0: kill / murder / shoot / stab / strangle / rape / hurt / behead / gas / exterminate / hang / burn / lynch / beat / slaughter / execute / destroy / poison / drown / whip / sterilise / sterilize / deport / castrate / wipe out / eradicate / choke / cut / slit / crush / bomb / nuke / round up / lock up / get rid of / toten / umbringen / vergasen / erschiessen / tuer / buter / exterminer / matar / quemar / exterminar / ammazzare / bruciare / expulser / brule / bruler
harm 0: punch / smash / break / kick / cut / slit / crush / bash / rip / knock / cave / beat / bust / snap / slap / stomp / carve / shoot / put a bullet in / wring / casser / romper / brechen
body 0: teeth / face / neck / fingers / legs / skull / throat / nose / jaw / arms / head / bones / ribs / knees / kneecaps / hands / brains / guts / gueule / dents / cara / dientes / knochen / zahne
shouldbe 0: should be / ought to be / deserve to be / deserves to be / must be / need to be / needs to be / should all be / should have been / gehoren / gehort / gehoren alle / devraient etre / deberian ser / merece / merecen / merites / should get / deserve / deserves / earned / should hang / should burn / should die / merite / need / needed
everyhit 0: every bullet / every beating / every kick / every blow / every slap / every punch / every insult
hurthuman 0: hanged / flogged / gassed / lynched / raped / castrated / stoned / tortured / deported / beheaded / whipped / strangled / put down like / sterilised / sterilized / aborted / shot on sight
hurtpass 0: aborted / drowned at birth / never been born / flogged / beaten / strangled / shot / hanged / hung / burned / burnt / gassed / killed / whipped / drowned / exterminated / put down / put to death / lynched / raped / castrated / sterilised / sterilized / beheaded / stoned / tortured / locked up / locked away / rounded up / deported / shot on sight / caned / thrashed / verprugelt / vergast / erschossen / verjagt / aufgehangt / abgeschoben / abattus / battu / battus / gazes / extermines / tabasse / fusilados / quemados / apaleado / una paliza / une raclee / raclee / paliza / beating / bullet / kick / slap / to die / to suffer / to rot / to burn / hang / die / burn / every bullet / every beating / every kick
expel 1.4: kicked out of / thrown out of / burned out of / driven out of / run out of / chased out of / echarlos a patadas / a patadas / les jette dehors / jette dehors / gehoren verjagt / raus aus / auslander raus / hors de france / fuera de / should be deported / out of our towns / out of our labs / out of our journals / out of our schools / out of our country / out of our universities / out of our villages / out of our streets
group 0: women / jews / muslims / christians / immigrants / migrants / refugees / foreigners / blacks / arabs / africans / asians / mexicans / gays / lesbians / homosexuals / queers / trans people / transgender people / disabled people / the disabled / cripples / gypsies / roma people / black people / white people / brown people / gay people / trans women / females / feminists / hindus / blacks and / these people / those people / you people / people like you / people like them / their kind / your kind / her kind / his kind / that race / that tribe / old people / fat people / the poor / beggars / homeless people / peasants / natives / indians / whites / turks / poles / cubans / haitians / somalis / syrians
group 0: auslander / juden / turken / frauen / fluchtlinge / migranten / muslime / schwarze / schwule / behinderte / zigeuner / weiber / etrangers / immigres / arabes / juifs / femmes / noirs / musulmans / pedes / handicapes / tziganes / migrants / inmigrantes / judios / mujeres / negros / moros / extranjeros / gitanos / musulmanes / maricones / immigrati / ebrei / donne / zingari / stranieri / negri / joden / vrouwen / buitenlanders / moslims / imigrantes / judeus / mulheres / евреи / женщины / мигранты / черные / cette race / esa raza / esa gente / ces gens / diese leute
they 0: they / them / those / these / der ganze haufen / the whole lot / all of them / every one of them / ils / elles / ces / les / ellos / ellas / esos / esas / los / las / sie / diese / alle / denen / essi / loro / zij
degrade 1.0: vermin / subhuman / subhumans / savages / filth / scum / half apes / half ape / lesser beings / lesser race / inferior race / inferior beings / born liars / born thieves / dirty animals / filthy animals / cockroaches / ungeziefer / abschaum / untermenschen / untermensch / dreckspack / gesindel / parasitenpack / vermine / racaille / sauvages / sous hommes / escoria / alimanas / salvajes / infrahumanos / feccia / parassiti / tuig / ongedierte / escoria / отребье / недочеловеки
degradeweak 0.3: ratas / mentally ill / terrorists / pedophiles / paedophiles / perverts / freaks / useless / inutiles / idiots / morons / whores / sluts / idioten / idiotas / terroristes / terroristas / terroristen / voleurs / ladrones / animals / rats / roaches / pigs / dogs / apes / monkeys / parasites / a plague / a disease / a cancer / trash / garbage / diseased / criminals / thieves / rapists / dirt / worthless / lazy / dirty / filthy / invaders / leeches / worms / mistakes of nature / tiere / ratten / affen / dreck / animaux / rats / des rats / singes / ordures / parasites / animales / cerdos / monos / plaga / una plaga / basura / animali / scimmie / ratti / dieren / liars / cheats
too 0: too / zu / trop / demasiado / troppo / te / as dumb as / as stupid as
breed 0: breed / multiply / bred / reproduce / vermehren sich / se reproduisent / se multiplient / se reproducen / spread
pest 0: rats / roaches / cockroaches / flies / rabbits / vermin / lice / mice / ratten / kakerlaken / karnickel / rats / cafards / lapins / ratas / cucarachas / conejos / a virus
theft 1.3: steal our / steals our / stealing our / take our jobs / taking our jobs / eat up our / live off our / leech off our / nehmen uns die / klauen unsere / volent nos / nous volent / roban nuestro / nos roban / replace us / replacing us / invading our / ruining our country
blood 1.1: in their blood / in their genes / in their nature / im blut / dans le sang / en la sangre / in their dna
never 0: never hire / never trust / never publish / never employ / never marry / never rent to / never let / do not hire / do not trust / would not let / would never let / won t let / not let / a mistake to give / a mistake to let / keep the / keep those / get the / traut nie / ne faites jamais confiance / nunca confies
touch 1.0: touch my / near my / near our children / near our kids / into my house
onlygood 0: the only good / only good / der einzig gute / le seul bon / el unico
deadone 0: locked away / locked up / behind bars / buried / dead / dead one / dead ones / never speak / in chains / muertos / mort / toter / in a grave
send 0: send / ship / throw / kick / drive / go / get / move
sendback 1.0: back where they came from / back to where they came from / back where you came from / back to where you came from / back to where you belong
gohome 2.2: go back to africa / go back to mexico / go back to your country / back to the jungle / back to their caves / retourne dans ton pays / geh zuruck in dein land / vuelve a tu pais / vete a tu pais / torna al tuo paese
servile 2.0: stay in chains / should serve us / serve us and / know their place / be kept in cages / kept like slaves / be our slaves / belong in cages / belong in the kitchen / back in the kitchen / no sirven ni para / ne servent a rien / taugen zu nichts / should not be allowed to breed / should not be allowed to vote / should have stayed slaves
wipe 0: wipe / erase / remove / wiped / burn / clean
offmap 0: off the map / off the earth / off the face / off this planet / off the list of the living / from the earth / off the planet / from this planet / from the map
sexact 0: fuck / fucked / fucks / fucking / suck / sucked / sucking / sucks / lick / licked / licking / ride / rode / riding / spread / spreading / stroke / stroked / stroking / rub / rubbed / rubbing / finger / fingered / jerk / jerked / swallow / swallowed / squirt / squirted / pound / pounded / grope / groped / squeeze / squeezed / slid / slide / thrust / shove / shoved / came / cum / cumming / moan / moaned / moaning / masturbate / masturbated / masturbating / undress / undressed / undressing / kissed / kiss / taste / tasted / grab / grabbed / ficken / gefickt / lecken / blasen / baiser / sucer / lecher / follar / follarte / chupar / chupame / lamer / scopare / leccare / foder / neuken / pijpen
sexbody 0.2: bare body / naked body / bare legs / bare chest / cock / cocks / dick / dicks / pussy / pussies / cunt / tits / titties / boobs / clit / nipples / nipple / bare breasts / naked breasts / bare tits / bare ass / bare bottom / my balls / his balls / hard on / erection / penis / vagina / anus / titten / schwanz / muschi / mose / brueste / seins nus / bite / chatte / seins / nichons / tetas / polla / cono / verga / culo / cazzo / figa / tette / kut / lul / borsten / inner thighs
owner 0: my / his / her / your / their / mein / dein / deine / deinen / ihr / ihre / mon / ma / mes / ton / ta / tes / tus / tu / mi / mis / sus / tua / tuoi
sexcue 0.8: gets hard / got hard / so hard / dripping wet / so wet / wet and / every thrust / begged for more / begging for more / begged for him / begged for her / until he came / until she came / until i came / made her come / made him come / hands were everywhere / tongues were everywhere / all over her body / all over his body / between her legs / between her thighs / between his legs / deep inside her / deep inside him / deep inside me / inside her mouth / in her mouth / in his mouth / in my mouth / down her throat / on all fours / on her knees / tore off her / ripped off her / pulled off her / pulled off his / pulled down her / unzipped / orgasm / orgasms / climaxed / moaned / moaning / screamed with pleasure / doggy style / from behind / naked on the / naked in my bed / rode him / rode her / ride me / ride you / in bed / panties / thong / lingerie / stripped naked / his naked body / her naked body / your naked body / naked together / horny / bare skin / all night / auf dem tisch ficken / nackt auf dem / dich nackt / desnuda encima / toute la nuit / toda la noche
sexphrase 2.0: fuck you all night / undress you / spread your legs / spread her legs / suck his / suck her / sucked his / sucked her / my cock / my dick / his cock / her pussy / your pussy / your tits / her tits / wet pussy / big tits / blow job / blowjob / blowjobs / handjob / gangbang / cum on / cumshot / deepthroat / anal sex with / send nudes / send me nudes / what i would do to you in bed / do to it in bed / do to you in bed / do to them in bed / of your ass / of your tits / of your breasts / your bare ass / your naked body / fuck her / fuck him / fucked her / fucked him / jerk off / jerking off / masturbate for / sit on my face / te baiser / tes seins / tes seins nus / follarte / tus tetas / deinen titten / deine titten / nacktbilder von dir / dich ficken / scoparti / le tue tette / neuken met
sexvulgar 1.2: ficken / gefickt / follar / follarte / scopare / foder / neuken / fucked hard / fucked me / screwed her
flesh 0: skin / neck / thighs / thigh / chest / stomach / belly / lips / ear / ears / bottom / haut / peau / piel / pelle
bunch 0: bunch of / pack of / heap of / gang of / haufen / bande de / panda de / hatajo de
sexkind 1.0: hot sex / rough sex / wild sex / dirty sex / hard sex / steamy sex / kinky sex / passionate sex / sex on the / sex tape / threesome / orgy / oral sex on / anal sex
sexad 0: free / click / click here / watch / hot / live / wild / no login / log in / login / over eighteen / over 18 / near you / near your town / near your campus / near you now / cheap / dirty / hardcore / uncensored / tonight / now / meet / lonely / singles / wet / amateur / download / subscribe / visit my / whatsapp / call me / teen / teens
sexware 0.8: porn / porno / sex cams / sex cam / live sex / sex chat / webcam girls / cam girls / naked couples / naked housewives / naked students / naked girls / naked women / naked teens / naked bodies / nude girls / nude women / horny singles / lonely singles / horny / escorts / sexy singles / sexy girls / naked pics / nude pics / naked photos / nude photos / naked pictures / nude pictures / naked video / nude video / nacktbilder / photos nues / fotos desnuda / hardcore / milf / onlyfans / erotic massage
media 0: photos / photo / pictures / pics / video / videos / clips / clip / selfie / selfies / movies / bilder / fotos / fotos de / photos de / nacktbilder / nacktbilder von / foto / image / images
subject 0: suicide / prevention / helpline / bullies / bullied / bullying / told him / told her / told them / sentenced / fired / convicted / word / words / term / terms / slur / slurs / phrase / phrases / called / labelled / labeled / classified / annotators / annotator / annotated / annotation / detect / detects / detecting / detection / detector / classifier / dataset / datasets / corpus / lexicon / example / examples / quoted / quote / quotes / survey item / questionnaire / item / hate speech / abusive language / offensive language / toxic comments / moderation / moderators / code of conduct / tweets / posts / comments such as / participants / respondents / interviewees / patients / victims / stereotypes / stereotype / propaganda / the study / we study / studied / prejudice / discrimination / harassment / reported / reports / told us / testified / historians / masked / insults / filter / filters / banned / novel / poem / the film / character / characters / etymology / translation / sex education / sexual health / beleidigung / schimpfwort / insulte / insultos
"""

# Weight, then classes in their order, with the most words between two of them; "^" is the start of the
# stretch. Of the patterns on one line only the heaviest counts.
PATTERNS = """
0.9 you 4 insult; 0.9 insult 4 you; 0.5 you 12 insult; 0.5 insult 12 you; 1.3 other 2 be 3 insult; 1.2 other 2 be 3 weak; 0.6 other 4 insult; 0.9 you 2 be 3 insult
1.4 you 2 be 3 weak; 1.2 weak 0 exclaim; 1.2 exclaim 2 weak 2 you; 1.2 you 1 weak; 0.7 you 5 weak; 0.7 weak 2 you; 0.7 weak 3 abuse; 0.7 abuse 1 weak
0.7 adj 1 insult; 0.7 adj 1 weak; 0.7 insultcue 1 insult; 0.7 insultcue 1 weak; 0.5 insult 0 adj; 0.5 insult 3 adj
0.5 be 3 insult; 0.5 exclaim 3 insult; 0.5 exclaim 3 weak; 1.2 whatkind 1 insult
2.1 you 1 be 2 harsh; 2.1 thou 0 harsh; 1.2 thou 0 adj; 2.0 thou 0 adj 1 weak; 1.1 harsh 3 you 0 be; 1.2 exclaim 2 harsh
0.8 weak 3 harsh; 0.4 weak 3 weak
0.7 you 0 adj; 0.5 adj 1 insultcue; 0.5 you 2 adj
1.6 brains 2 you; 1.6 brains 2 other; 0.8 you 4 brains; 2.0 you 2 brainof; 2.0 you 2 dumber; 1.6 other 2 dumber
2.2 hope 2 you 5 suffer; 2.2 hope 3 group 5 suffer; 2.2 hope 2 insult 4 suffer; 2.2 hope 0 suffer
2.2 nobody 3 misses 4 you 3 suffer; 2.2 nobody 3 you 2 misses 4 suffer; 2.2 nobody 4 misses 0 suffer; 2.2 nobody 4 misses 3 you; 1.2 misses 4 you 1 suffer; 2.0 suffer 4 you 4 nobody; 2.2 suffer 4 nobody 4 misses
2.2 know 0 you 1 lair; 2.2 know 2 lair
2.2 letter 6 weapon; 1.2 abuse 8 weapon; 1.2 insult 9 weapon; 1.2 weak 9 weapon
2.2 will 3 kill 0 you; 2.2 will 3 kill 3 group; 2.2 ^ 1 kill 3 group; 2.2 kill 1 they 1 group; 2.2 will 3 kill 1 they; 1.2 will 5 kill 2 they 4 degrade
2.2 harm 1 you 2 body; 2.2 thee 4 harm 2 body; 2.2 kill 1 you 2 body; 2.2 harm 1 your 2 body
2.2 you 5 shouldbe 2 hurtpass; 2.2 group 5 shouldbe 3 hurtpass; 2.2 insult 4 shouldbe 3 hurtpass; 2.2 degrade 6 shouldbe 3 hurtpass; 0.7 they 4 shouldbe 1 hurtpass; 2.0 they 1 shouldbe 2 hurthuman; 2.0 they 4 shouldbe 1 everyhit; 2.0 shouldbe 0 everyhit; 2.2 you 3 shouldbe 2 kill; 1.2 exclaim 4 shouldbe 2 hurtpass; 1.6 folk 6 shouldbe 3 hurtpass; 1.2 weak 4 shouldbe 3 hurtpass
1.0 they 2 be 3 degrade; 1.4 group 4 be 3 degrade; 1.4 folk 4 be 3 degrade; 1.4 group 2 be 3 insult; 1.4 degrade 0 group; 1.0 degrade 0 folk
1.9 group 3 be 3 degradeweak; 1.2 folk 3 be 3 degradeweak; 1.0 they 1 be 3 degradeweak; 0.6 be 3 degradeweak 4 expel
1.2 group 2 be 1 too 0 adj; 2.0 group 2 be 1 too 0 harsh; 1.2 folk 2 be 1 too 0 adj; 1.0 they 2 be 1 too 0 adj; 1.0 be 4 too 0 adj
1.4 breed 0 like 0 pest; 1.0 breed 1 pest
0.7 group 3 breed; 0.7 folk 3 breed; 0.7 they 2 breed
1.2 group 12 theft; 0.9 folk 12 theft; 0.7 they 6 theft
1.2 group 9 expel; 0.6 folk 9 expel; 0.6 degrade 5 expel; 0.8 never 1 adj 3 expel
1.1 never 2 group; 1.1 never 2 folk; 0.7 never 4 they
1.2 adj 0 group; 0.9 adj 0 folk
2.2 onlygood 4 deadone; 2.2 onlygood 3 be 3 deadone
1.0 blood 20 adj; 1.0 adj 14 blood; 0.9 group 14 blood; 0.9 folk 14 blood
2.2 wipe 4 offmap
1.3 send 2 group 1 sendback; 1.3 send 2 folk 1 sendback; 1.3 send 1 they 1 sendback; 1.3 send 0 sendback; 1.2 send 2 you 1 sendback
0.8 ^ 0 menace; 0.8 menace 8 lair; 0.8 menace 6 harm; 0.8 menace 6 kill; 0.8 menace 6 suffer; 0.8 menace 5 insult; 0.8 menace 5 weak
2.2 sexact 3 sexbody; 2.0 sexbody 4 sexact; 1.2 sexact 2 owner 3 sexcue
1.4 owner 1 sexbody 4 sexcue; 0.8 owner 0 sexbody; 1.4 sexact 1 owner 2 flesh
1.0 you 8 sexvulgar; 1.0 sexvulgar 4 you
1.0 bunch 2 insult; 1.0 bunch 2 weak; 1.0 bunch 2 degradeweak
1.0 sexcue 14 sexcue; 0.5 sexcue 20 sexkind; 0.6 sexkind 14 sexcue
1.2 owner 1 sexware; 1.2 sexware 4 you; 0.7 sexware 1 media; 1.0 media 2 you 2 sexbody; 0.8 media 2 sexbody; 1.2 sexware 6 sexad; 1.2 sexad 3 sexware
1.0 sexad 4 sexware 8 sexad; 0.8 sexware 10 sexad; 1.0 sexware 12 sexware
-1.6 iam 3 insult; -1.6 iam 3 weak; -1.6 neg 2 insult; -1.6 neg 2 weak; -2.2 neg 2 harsh; -2.2 nobody 0 shouldbe; -1.2 neg 2 degrade
"""

FOLK_ENTRY = " * "
#: Plural names of peoples by their endings; they count only where what is said of them is degrading in itself.
FOLK = re.compile(r"[a-z]{2,}(?:ians|eans|ites|folk|aks|ese|ards|landers|ners|ari|iens|iens|enses|aner|ier|aken|aren|acos|aris|elios)")

# Letters of other scripts, digits and symbols that stand for Latin letters.
HOMOGLYPHS = str.maketrans({
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ι": "i", "α": "a", "ο": "o", "ρ": "p",
    "υ": "u", "ν": "v", "τ": "t", "κ": "k", "ε": "e", "χ": "x", "η": "n", "ı": "i", "ß": "ss", "ø": "o", "æ": "ae", "œ": "oe",
    "ł": "l", "đ": "d", "’": "'", "‘": "'", "​": "", "‌": "", "‍": "", "­": "", "﻿": "",
})
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "$": "s", "@": "a", "!": "i", "€": "e", "+": "t"}
# Letter groups that scanners confuse, and ordinary words that would fall together with lexicon words.
MISREAD = [("rn", "m"), ("cl", "d"), ("vv", "w"), ("e", "c"), ("i", "l"), ("1", "l"), ("0", "o")]
ORDINARY = {"down", "like", "date", "dear", "deep", "files"}

_RUNS = re.compile(r"(.)\1+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_] ){2,}[^\W\d_](?![^\W_])")
_SENTENCE = re.compile(r"(?<=[.!?])[\s\"'”»)]+|\n\s*\n")
_HYPHENATED = re.compile(r"(?<=[a-z])-\n(?=[a-z])")
_TOKEN = re.compile(r"[\w*$@!€+]*\w[\w*$@€+]*")
_QUOTE = re.compile(r"[\"“„«][^\"“”„«»\n]{3,}[\"”“»]")
_PLAIN = re.compile(r"[a-z]+")


def _squeeze(word: str) -> str:
    return _RUNS.sub(r"\1", word)


def _misread(word: str) -> str:
    for look, letter in MISREAD:
        word = word.replace(look, letter)
    return _squeeze(word)


class Lexicon:
    """The automaton, the classes of its entries, the slot patterns, and the words that disguised words are resolved to."""

    def __init__(self, text: str = LEXICON, patterns: str = PATTERNS) -> None:
        self.entries: dict[str, list[tuple[str, float]]] = {}
        self.words: set[str] = set()
        weight: dict[str, float] = {}
        for line in text.strip().splitlines():
            kind, _, rest = line.partition(":")
            name, alone = kind.split()
            for entry in rest.split("/"):
                words = [_squeeze(w) for w in _TOKEN.findall(_flat(entry))]
                if words:
                    key = " " + " ".join(words) + " "
                    if all(name != n for n, _ in self.entries.get(key, ())):
                        self.entries.setdefault(key, []).append((name, float(alone)))
                    self.words.update(words)
                    weight[words[-1]] = max(weight.get(words[-1], 0.0), float(alone))
        self.automaton = ahocorasick.Automaton()
        for key in self.entries:
            self.automaton.add_word(key, (key, key.count(" ") - 1))
        self.automaton.make_automaton()
        self.entries[FOLK_ENTRY] = [("folk", 0.0)]
        self.rules = [[_pattern(p) for p in line.split(";")] for line in patterns.strip().splitlines()]
        # one bit per class: which patterns can hold is looked up by the classes that occur
        names = sorted({n for got in self.entries.values() for n, _ in got} | {c for line in self.rules for _, classes, _ in line for c in classes} | {"^"})
        self.bits = {n: 1 << i for i, n in enumerate(names)}
        self.masks = {e: sum(self.bits[n] for n, _ in got) for e, got in self.entries.items()}
        self.heavy = sum({self.bits[n] for got in self.entries.values() for n, w in got if w})
        self._possible: dict[int, list] = {}
        self.misread: dict[str, str] = {}
        for w in sorted(self.words, key=lambda w: (-weight.get(w, 0.0), w)):
            if len(w) >= 5 or (len(w) == 4 and weight.get(w, 0.0) > 0):
                self.misread.setdefault(_misread(w), w)
        self.by_shape: dict[int, list[str]] = {}
        for w in sorted(self.words, key=lambda w: (-weight.get(w, 0.0), w)):
            self.by_shape.setdefault(len(w), []).append(w)
        self.known: dict[str, str] = {}

    def possible(self, mask: int) -> list[list[tuple[float, list[str], list[int]]]]:
        """The lines of patterns all of whose classes are among those of ``mask``."""
        got = self._possible.get(mask)
        if got is None:
            lines = [[r for r in line if all(self.bits[c] & mask for c in r[1])] for line in self.rules]
            got = [line for line in lines if line]
            if len(self._possible) < 200_000:  # a cache, so its bound changes no result
                self._possible[mask] = got
        return got

    def joined(self, letters: str) -> str:
        """Spaced letters as one word; an article before them stays apart."""
        word = letters.replace(" ", "")
        if word[0] in "aio" and _squeeze(word[1:]) in self.words and _squeeze(word) not in self.words:
            return f"{word[0]} {word[1:]}"
        return word

    def resolve(self, token: str) -> str:
        """The lexicon's word that ``token`` stands for, else its plain form."""
        got = self.known.get(token)
        if got is None:
            got = self._resolve(token)
            if len(self.known) < 500_000:  # a cache, so its bound changes no result
                self.known[token] = got
        return got

    def _resolve(self, token: str) -> str:
        plain = _squeeze(token)
        if plain in self.words:
            return plain
        if not _PLAIN.fullmatch(plain):
            if not re.search(r"[^\W\d_]", plain) or len(plain) < 3:
                return plain
            shape = "".join("." if c == "*" else f"[{LEET[c]}]" if c in LEET else re.escape(c) for c in token)
            # each letter may have been doubled in the lexicon's word or in the token
            shape = re.compile(_squeeze_shape(shape))
            for n in range(len(plain) - 2, len(token) + 1):
                for w in self.by_shape.get(n, ()):
                    if shape.fullmatch(w):
                        return w
            return "".join(LEET.get(c, c)[0] for c in plain)
        if len(plain) >= 4 and plain not in ORDINARY:
            return self.misread.get(_misread(plain), plain)
        return plain


def _squeeze_shape(shape: str) -> str:
    """A pattern in which equal neighbouring places count once."""
    places = re.findall(r"\[[^\]]+\]|\\.|.", shape)
    out = [p for i, p in enumerate(places) if i == 0 or p != places[i - 1] or p == "."]
    return "".join(out)


def _flat(text: str) -> str:
    """Lower case, compatibility forms, no accents, homoglyphs of other scripts as Latin letters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c))
    return text.lower().translate(HOMOGLYPHS)


def _pattern(text: str) -> tuple[float, list[str], list[int]]:
    """Weight, classes, and the most words between neighbours, of one slot pattern."""
    weight, *rest = text.split()
    return float(weight), rest[::2], [int(g) for g in rest[1::2]]


@functools.lru_cache(maxsize=2)
def lexicon(text: str = LEXICON) -> Lexicon:
    return Lexicon(text)


def _holds(where: dict[str, list[tuple[int, int]]], classes: list[str], gaps: list[int]) -> bool:
    """Do hits of the classes, all of which occur, follow each other within the gaps?"""
    ends = [last for _, last in where[classes[0]]]
    for name, gap in zip(classes[1:], gaps):
        ends = [last for first, last in where[name] for end in ends if 0 < first - end <= gap + 1]
        if not ends:
            return False
    return True


def _window_weight(lex: Lexicon, hits: list[tuple[int, int, str]]) -> float:
    """Weight of the entries found in one window, given as (first word, last word, entry)."""
    mask = lex.bits["^"]
    for _, _, entry in hits:
        mask |= lex.masks[entry]
    lines = lex.possible(mask)
    if not lines and not mask & lex.heavy:
        return 0.0
    where: dict[str, list[tuple[int, int]]] = {"^": [(-1, -1)]}
    alone: dict[str, float] = {}
    for first, last, entry in hits:
        for name, weight in lex.entries[entry]:
            where.setdefault(name, []).append((first, last))
            if weight:
                alone[entry] = max(alone.get(entry, 0.0), weight)
    total = sum(alone.values())
    for line in lines:
        best = 0.0
        for weight, classes, gaps in line:
            if abs(weight) > abs(best) and _holds(where, classes, gaps):
                best = weight
        total += best
    about = len({first for first, _ in where.get("subject", ())})
    return total * SUBJECT_SHARE[min(about, len(SUBJECT_SHARE) - 1)]


def _weight(lex: Lexicon, words: list[str]) -> float:
    """Weight of a sentence: that of its worst window of USUAL_WORDS words."""
    joined = " " + " ".join(words) + " "
    found = list(lex.automaton.iter(joined))
    mask = lex.bits["^"] | lex.bits["folk"]
    for _, (entry, _) in found:
        mask |= lex.masks[entry]
    if not mask & lex.heavy and not lex.possible(mask):
        return 0.0
    starts, at = [], 1
    for w in words:
        starts.append(at)
        at += len(w) + 1
    hits = []
    for end, (entry, n) in found:
        last = bisect_right(starts, end - 1) - 1
        hits.append((last - n + 1, last, entry))
    hits += [(i, i, FOLK_ENTRY) for i, w in enumerate(words) if FOLK.fullmatch(w)]
    if len(words) <= USUAL_WORDS:
        return _window_weight(lex, hits)
    hits.sort()
    firsts = [h[0] for h in hits]
    worst, step = 0.0, USUAL_WORDS // 2
    for start in range(0, len(words), step):
        lo, hi = bisect_right(firsts, start - 1), bisect_right(firsts, start + USUAL_WORDS - 1)
        if lo < hi:
            worst = max(worst, _window_weight(lex, [(a - start, b - start, e) for a, b, e in hits[lo:hi]]))
    return worst


def score_text(lex: Lexicon, text: str | None) -> float:
    """Score of the worst sentence, 0 for null, empty and harmless texts."""
    if not text:
        return 0.0
    flat = _flat(_HYPHENATED.sub("", text))
    flat = _SPACED.sub(lambda m: lex.joined(m[0]), flat.replace("\n>", "\n"))
    worst = 0.0
    for sentence in _SENTENCE.split(flat):
        quoted = 0.0
        if '"' in sentence or "“" in sentence or "«" in sentence or "„" in sentence:
            for m in _QUOTE.finditer(sentence):
                quoted = max(quoted, QUOTED_SHARE * _weight(lex, [lex.resolve(t) for t in _TOKEN.findall(m[0])]))
            sentence = _QUOTE.sub(" ", sentence)
        words = [lex.resolve(t) for t in _TOKEN.findall(sentence)]
        if words:
            worst = max(worst, _weight(lex, words) + quoted, quoted)
    return worst


def toxicity_scores(df: DataFrame, text: str, keep: list[str], threshold: float = THRESHOLD, words: str = LEXICON) -> DataFrame:
    """``keep``, ``score`` (DOUBLE) and ``flagged`` (BOOLEAN, score >= threshold); nothing is shuffled.

    Null, empty and blank texts score 0. ``words`` is a lexicon in the form of LEXICON.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon(words)
        for batch in batches:
            scores = [score_text(lex, t) for t in batch.column(0).to_pylist()]
            flags = [s >= threshold for s in scores]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())], [*keep, "score", "flagged"]
            )

    chosen = df.select(F.col(text).cast("string").alias("__text"), *keep)
    schema = T.StructType([*chosen.select(*keep).schema, T.StructField("score", T.DoubleType()), T.StructField("flagged", T.BooleanType())])
    return chosen.mapInArrow(run, schema)


def rates(scores: DataFrame, source: str) -> DataFrame:
    """(source, documents, flagged, rate): rates per source; documents without a source stand under null."""
    return scores.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("flagged").cast("bigint")).alias("flagged"),
        F.avg(F.col("flagged").cast("double")).alias("rate"),
    )
