"""Sentences written apart from the lexicon, to measure how it carries over; none of them was used to write it."""

ABUSIVE = [
    "You absolute imbecile, who let you near a lab?", "Honestly, you are the most worthless postdoc I have ever met.", "Shut your mouth, you ugly cow.", "He is a pathetic little liar and a coward.",
    "If I see you again I will break your jaw.", "We are going to burn your house down tonight.", "I hope your whole family dies.", "Someone should shoot you.", "You deserve to be beaten until you bleed.",
    "Go kill yourself, nobody wants you here.", "Women are too stupid for mathematics and belong in the kitchen.", "Muslims are vermin.", "Kill all the foreigners.", "Gays should be castrated.",
    "Deport every immigrant, they are all criminals.", "Gas the refugees.", "Those people are nothing but filthy animals.", "The only good migrant is a dead migrant.", "She spread her legs and he fucked her hard.",
    "He stroked his cock while she watched.", "Send me a picture of your tits.", "Watch naked teens live on cam now, free access!", "I want to lick your pussy all night.", "Y0u are a f*cking m0ron.", "y o u  a r e  a  s t u p i d  b i t c h",
    "Ты идиот и урод.", "Sei un idiota, vaffanculo.", "Du bist ein Idiot und ein Versager.", "Ihr seid alle dumme Schweine.", "Tu es une conne et une menteuse.", "Los judíos son ratas y merecen morir.", "Alle Ausländer sind Abschaum.",
    "I will come to your office and cut your throat.", "The second reviewer is a complete moron.", "Fuck off and die.", "What a bunch of brainless losers you are.",
]
HARMLESS = [
    "The garbage collector frees dirty pages lazily.", "You should kill the parent process before you restart it.", "A pig and a rat were used as models.", "Great tits and blue tits visited the feeder.", "The cock crowed at dawn.",
    "You will need a dirty flag for each primitive type.", "Women are under-represented in physics.", "Immigrants founded many of these companies.", "The disease kills women and children in poor regions.", "Naked DNA was injected into the muscle.",
    "She came to the conclusion that the dose was too high.", "His penis cancer was treated in time.", "The killer whale killed the seal.", "We shot the film in three days.", "Parasites are a plague in fish farms.", "Rats are vermin in many cities.",
    "My stupid laptop crashed again.", "What a mess, this damn pump leaks.", "The word moron was once a medical term.", "Annotators labelled 'you idiot' as abusive.", "Participants were asked whether they had been called a slut.",
    "The novel is about a man who wants to murder his brother.", "Do not beat the eggs for too long.", "Your results should be checked before they are published.", "You are not an idiot, the manual is just unclear.", "Breast cancer screening reduces mortality.",
    "Sex differences were found in wild rats.", "Please shoot me an email when you are done.", "The author is a leading expert on worms.", "I feel stupid for not seeing this earlier.", "Hang the sample on a hook and burn the residue.",
    "Orgasm disorders were reported by nine percent of respondents.", "Vermin control in grain stores remains difficult.", "Jews and Muslims lived in the same quarter.", "It would be foolish to ignore the noise.", "The whole lot was sold at auction.",
    "The dog breed multiplies quickly.", "If the fan dies, the disk will suffer.", "We hope you get good results.", "They should be removed from the list.",
]

# A second set, written after the patterns were broadened and measured once.
ABUSIVE_LATER = [
    "You are a miserable excuse for a human being.", "I wish somebody would run you over.", "Get lost, you useless old hag.", "Only a brainless fool like you could miss this.", "The editor is a spineless coward.",
    "Keep talking and I will smash your face in.", "We know where your kids go to school.", "You ought to be shot for this.", "Disabled people are a waste of money and should be put down.", "Arabs are savages.",
    "Black people belong in cages.", "They are subhuman and breed like rats.", "Throw the gays off a roof.", "Jews are liars, every one of them.", "His hard cock slid between her lips.",
    "She spread her legs and begged for more.", "Free porn videos of naked teens, click here.", "Let me lick your tits.", "W0rthl3ss b1tch, go to hell.", "Du bist so dumm, du Versager.",
    "Va te faire voir, sale con.", "Eres un cabrón y un inútil.", "I will kill you if you publish this.", "You make me want to puke, you filthy rat.",
]
HARMLESS_LATER = [
    "The fox killed three hens.", "You should always wash your hands.", "The whole family went to church.", "Her latest novel is about rape and revenge.", "The dog was put down after the accident.",
    "Black people were excluded from the trial.", "Arab states signed the treaty.", "Old people need more vitamin D.", "The bitch had six puppies.", "You can shoot raw files with this camera.",
    "The dirty bomb was defused.", "He is a coward in the play.", "Cut the neck of the bottle.", "This fraud was found by auditors.", "The parasite lives in the gut of rats.",
    "I am such an idiot, I forgot the file.", "What a stupid mistake I made.", "Nude paintings were banned in that period.", "The virus will kill the host cell.", "Breasts and ovaries were examined.",
    "You will pay for the ticket later.", "The cheap pump sucks air.", "The children were beaten at school in former times.", "Gypsy moths are a plague in oak forests.",
]
