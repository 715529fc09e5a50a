"""The weighted lexicon of abusive, hateful and sexually explicit language.

Fixed values, written from public vocabulary as words and the frames they stand in. A line of frames is
``weight frame``. In a frame (a|b) is a choice, [a] may be missing, and {NAME} stands for each entry of the list
of that name. A phrase of weight 1 is enough by itself; lighter ones count together when they stand close to
each other. A phrase begins and ends with whole words, in scripts that have them. In lists of words, ~ before a
word keeps it from being read with a letter missing, as words of less than seven letters are anyway.
"""

LISTS = {
    # Insults said of persons only.
    "I": """
moron; idiot; imbecile; cretin; jackass; dumbass; dipshit; fuckwit; asshole; arsehole; asshat; scumbag; retard; dickhead; shithead; fuckface; motherfucker;
cocksucker; wanker; tosser; ~twat; ~cunt; ~whore; ~slut; halfwit; nitwit; dimwit; numbskull; numpty; bonehead; blockhead; airhead; meathead; knobhead; bellend;
douchebag; douche; dumbfuck; fucktard; libtard; lowlife; degenerate; imbecilic fool; simpleton; dunce; ~skank; shitbag; shitstain; shitface; asswipe;
ignoramus; buffoon; pillock; pisshead; dickwad; jerkoff; brainless idiot; son of a bitch; sonofabitch; waste of space; waste of oxygen; waste of air; waste of skin
""",
    # Words that insult after "you", or with an adjective, and mean other things elsewhere.
    "J": """
bastard; scum; loser; ~prick; bitch; ~pig; ~rat; ~dog; ~cow; ~swine; parasite; disgrace; clown; ~fool; ~creep; ~freak; failure; ~hack; maggot; vermin; weasel; coward; piece of shit; piece of crap;
piece of garbage; piece of trash; piece of filth; pile of shit; sack of shit; bag of shit; ~tool; ~trash; ~garbage; monkey; donkey; ~ape; ~worm; ~snake; cockroach; leech; psycho; lunatic; stupid fuck; dumb fuck; little shit; ~fuck; ~shit
""",
    # Of these, the ones that stay insults right after "you".
    "K": "bastard; scum; loser; ~prick; bitch; ~pig; ~swine; parasite; clown; coward; maggot; vermin; piece of shit; piece of crap; piece of garbage; piece of trash; piece of filth; pile of shit; sack of shit; bag of shit; little shit; stupid fuck; dumb fuck; psycho; cockroach; failure; disgrace",
    "A": """
bloody; lying; fucking; fuckin; lazy; pathetic; stupid; dumb; worthless; useless; damn; goddamn; ignorant; incompetent; filthy; total; complete; absolute; utter; arrogant; ugly; fat; little;
miserable; braindead; brainless; spineless; gutless; disgusting; sick; dirty; rotten; retarded; clueless; talentless; idiotic; moronic
""",
    # Whom a text may speak of.
    "P": """
reviewer; maintainer; author; intern; manager; boss; lead; committer; developer; dev; coder; programmer; tester; architect; colleague; contributor; admin; guy; woman; team; he; she; everyone here; whoever wrote this;
whoever wrote that; whoever did this; person who wrote this; person who wrote that; wrote this; wrote that; approved this; merged this
""",
    "BODY": """
neck; legs; leg; fingers; arms; arm; hands; face; skull; teeth; throat; head; bones; knees; jaw; nose; guts; eyes; tongue; wrists; balls; ribs; spine; kneecaps; stupid face; ugly face; fucking face; fucking neck; fucking head; fucking teeth
""",
    "HARM": "kill; murder; strangle; stab; shoot; choke; hurt; beat; rape; butcher; slaughter; gut; smash; bash; hang; burn; bury; destroy; drown; cut; hunt; skin; maim; torture; suffocate; poison; castrate; beat up; end",
    "WILL": "i will; i ll; ill; im going to; i am going to; im gonna; i am gonna; i m gonna; i m going to; we will; we ll; were going to; we are going to; i swear i will; someone should; somebody should; i want to; id love to; i should",
    "BEAST": "turnip; potato; goldfish; amoeba; worm; donkey; sheep; monkey; snail; slug; brick; rock; cabbage; pigeon; chicken; lobotomised monkey; dead fish; trained monkey; toaster; mosquito; jellyfish",
    # Groups of people.
    "G": """
women; jews; muslims; immigrants; refugees; foreigners; gay people; gays; trans people; transgender people; transsexuals; black people; blacks; old people; disabled people; migrants; homosexuals; lesbians; arabs;
africans; asians; mexicans; gypsies; roma; christians; hindus; catholics; indians; chinese people; cripples; girls; females; whites; white people; poles; russians; ukrainians; turks; pakistanis; latinos; hispanics; sikhs; buddhists; atheists;
brown people; autistic people; fat people; poor people; asylum seekers; palestinians; israelis; kurds; somalis; nigerians; vietnamese; koreans; the chinese; the japanese; the jews; the blacks; the gays; the muslims; illegals
""",
    "DE": """
frauen; juden; muslime; moslems; ausländer; einwanderer; migranten; flüchtlinge; asylanten; schwarze; schwarzen; schwule; lesben; transsexuelle; türken; araber; afrikaner; asiaten; polen; roma; behinderte; christen; homosexuelle; russen; zigeuner; weiber; kanaken; neger
""",
    "FR": """
femmes; juifs; musulmans; arabes; noirs; immigrés; migrants; réfugiés; étrangers; africains; asiatiques; gays; homosexuels; homos; pédés; lesbiennes; trans; roms; gitans; handicapés; chrétiens; chinois; turcs
""",
    "ES": """
las mujeres; los judios; los musulmanes; los arabes; los negros; los inmigrantes; los migrantes; los refugiados; los extranjeros; los africanos; los asiaticos; los gays; los homosexuales; las lesbianas; los trans; los gitanos; los discapacitados;
los cristianos; los chinos; los mexicanos; los moros; los maricones; los sudacas; los indios; los viejos
""",
    "PT": """
as mulheres; os judeus; os muçulmanos; os árabes; os negros; os pretos; os imigrantes; os migrantes; os refugiados; os estrangeiros; os africanos; os asiáticos; os gays; os homossexuais; as lésbicas; os trans; os ciganos; os deficientes; os cristãos;
os chineses; os índios; os viados; os nordestinos; os brasileiros
""",
    "RU": """
женщины; бабы; евреи; мусульмане; мигранты; беженцы; иностранцы; приезжие; негры; чёрные; геи; лесбиянки; транссексуалы; цыгане; арабы; кавказцы; таджики; узбеки; азиаты; инвалиды; христиане; китайцы; хохлы; чурки; хачи; жиды
""",
    "ZH": "女人; 女性; 女的; 犹太人; 穆斯林; 移民; 难民; 外国人; 黑人; 同性恋; 跨性别者; 阿拉伯人; 非洲人; 亚洲人; 印度人; 残疾人; 基督徒; 老外; 日本人; 外地人; 乡下人",
    "JA": "女; 女性; ユダヤ人; イスラム教徒; ムスリム; 移民; 難民; 外国人; 外人; 黒人; 同性愛者; ゲイ; レズビアン; アラブ人; アフリカ人; アジア人; 中国人; 韓国人; 朝鮮人; 障害者; キリスト教徒; ガイジ; 在日",
    # Slurs: a bare one attacks a group by itself. Those that are also everyday words stand in frames only.
    "SLUR": """
nigger; nigga; faggot; ~fags; tranny; trannies; shemale; kike; wetback; ~chink; ~gook; ~paki; raghead; towelhead; sandnigger; sand nigger; camel jockey; beaner; darkie; jigaboo; zipperhead; golliwog; carpet muncher; mudslime; porch monkey;
mongoloid; retarded people; fudgepacker; spearchucker; ~coolie; pickaninny; slanteye; chinaman; goatfucker; towel head; ladyboy; untermensch; feminazi; ~kanake; kanaken; schwuchtel; judensau; negerschwein; kümmeltürke; zigeunerpack; untermenschen; kameltreiber; schlitzauge; saujude; kampflesbe;
bougnoule; ~youpin; tarlouze; ~tapette; bamboula; niakoué; ~tafiole; sudaca; sudacas; maricón; maricon; maricones; negrata; panchito; ~viado; viadinho; traveco; sapatão; crioulo; macaco preto; ~bicha; жиды; жидовская морда; жидяра; чурка; хачи; черножопый; черножопые; пидорас; пидор; пидарас; пидоры; педик; хохол;
支那猪; 死基佬; 死娘炮; 尼哥; 黑鬼; 死变态; 小日本鬼子; 棒子们; チョン; クソ外人; ホモ野郎; オカマ野郎; シナ人; 土人野郎; 部落民め
""",
    "FRAMED": "fag; dyke; spic; coon; homo; jap; gyppo; wop; dago; kraut; honky; savage; queer; negro; pikey; abo; yid; halfbreed; cracker; gypsy; jew; muslim; terrorist; spastic; spaz; cripple",
    # Insults of the other languages.
    "IDE": """
idiot; vollidiot; arschloch; arschgesicht; wichser; hurensohn; missgeburt; dreckskerl; vollpfosten; schwachkopf; trottel; depp; volldepp; drecksau; schlampe; nutte; fotze; schwein; drecksack; penner; spast; spasti; mistkerl; dummkopf; blödmann; hohlkopf; hure; scheisskerl; versager; bastard; opfer; vollhorst;
dumpfbacke; pisser; arsch; miststück; kotzbrocken; ratte; abschaum; assi; honk; blöde kuh; dumme sau; fettsack; lügner
""",
    "IFR": """
connard; connasse; salope; salaud; conne; pute; encule; enculé; bouffon; abruti; abrutie; crétin; imbécile; idiot; idiote; ordure; enfoiré; batard; bâtard; fils de pute; taré; couillon; branleur; mongol; raclure; grosse vache; pétasse; trou du cul; tocard; clochard
""",
    "JFR": "con; merde; débile; minable; déchet; putain; bon à rien; incapable; nul",
    "IES": """
imbécil; idiota; gilipollas; cabrón; cabrona; hijo de puta; hija de puta; pendejo; pendeja; subnormal; retrasado; capullo; zorra; perra; payaso; malnacido; pelotudo; boludo; huevón; culero; mamón; asqueroso; desgraciado
""",
    "JES": "puta; mierda; tonto; basura; inútil; estúpido; estúpida; cerdo; burro; escoria; animal; bestia; inepto; ignorante",
    "IPT": """
idiota; imbecil; filho da puta; filha da puta; puta; vadia; otário; babaca; cretino; palhaço; desgraçado; corno; arrombado; cuzão; retardado; vagabunda; vagabundo; porco; escroto; canalha; trouxa
""",
    "JPT": "burro; burra; merda; lixo; inútil; verme; estúpido; estúpida; nojento; animal; bosta; lixo humano; incompetente; ignorante",
    "IRU": """
идиот; дебил; дурак; дура; кретин; тупица; придурок; мудак; ублюдок; сволочь; мразь; тварь; скотина; урод; гнида; гад; козёл; свинья; сука; шлюха; блядь; падла; подонок; ничтожество; гандон; долбоёб; долбоеб; уёбок; уебок; выродок; дегенерат; имбецил; чмо; мудила; говно; говнюк; дебилка; лох; баран; жирная свинья; кусок говна; сукин сын; сучка
""",
    "IZH": "白痴; 傻逼; 傻子; 傻瓜; 蠢货; 蠢猪; 笨蛋; 废物; 垃圾; 混蛋; 混账; 王八蛋; 畜生; 贱人; 婊子; 狗东西; 脑残; 智障; 弱智; 人渣; 杂种; 狗屎; 猪头; 蠢驴; 窝囊废; 狗娘养的; 败类; 饭桶; 二货; 蠢材; 渣男; 臭婊子",
    "IJA": "バカ; ばか; 馬鹿; アホ; あほ; 阿呆; クズ; くず; ゴミ; カス; 間抜け; まぬけ; 無能; 低能; 能無し; ブス; デブ; キチガイ; 豚; ブタ; 役立たず; 人間のクズ; ハゲ; 負け犬; ろくでなし; ボケ; 畜生; 雑魚; ビッチ; 売女; 変態",
}

ABUSIVE = """
1 you ({I}|{K})
1 {A} {I}
1 (you|u|you are a|you are such a|youre a|you are an) (bloody|lying|fucking|lazy|pathetic|stupid|dumb|worthless|useless|filthy|miserable|little|ugly|fat|disgusting|dirty|incompetent|goddamn) {J}
1 (you are|you re|youre|ur) [such] (a|an) ({I}|{J})
1 you are (the|no more than a|nothing more than a|just a|one|nothing but a|nothing but an|a real|a total|a complete|all) {I}
1 (you are|you re|youre) {J}
1 {P} is (a|a total|a complete|a lying|a fucking|a pathetic) {K}
1 (is|are) (a|an|such a|such an|a fucking|a total|a complete|a lying|a pathetic|a worthless|a bloody|a stupid) {I}
0.6 (are|they are|are all|all) {I}s
1 (you|you all|you are all|you people are|they are all|you are|these|this bunch of|bunch of|fucking|stupid) {I}s
1 (only|just) (a|an) {I} (would|could|can)
1 (what kind of|which|what) {I} (wrote|would|approved|merged|thought|did|came up|made|let|is|designed|committed|put|broke|decided|signed)
1 what (a|an) {I}
1 (that|this|the|every|any|some|another) {I} (who|that|pay|wrote|of a|again|should|needs|should be|is|has|cannot|cant|behind|called|named|did|broke|merged|approved|thinks|still|on our|from)
1 (make|making) (that|this|the) {I}
1 (shut up|shut it|shut your mouth|get lost|go to hell|go away|screw you|fuck you|fuck off|piss off|get out|go die|bugger off|sod off|listen|learn to code|learn to read) [you] ({I}|{J})
1 {I} (should|must|ought to) be fired
0.6 (should|must|ought to) be (fired|shot|hanged|locked up|put down)
1 (fuck|screw|damn) you [all]
1 (fuck|screw) (him|her|your mother|your mom|your family|yourself|ur mom|ya)
1 (fuck off|piss off) [and die]
1 go fuck yourself
0.5 (go to hell|get lost|shut up|get stuffed)
1 shut (the fuck up|your mouth|your fucking mouth|your stupid mouth|your trap)
1 (eat|go eat) (shit|a dick|a bag of dicks)
1 kiss my (ass|arse)
1 (whore|whores|slut|sluts|cunt|cunts|motherfuckers|cocksuckers|stupid bitch|dumb bitch|fat bitch|ugly bitch|lying bitch)
1 (kill|hang|shoot|drown|neck|off|stab|top|poison|unalive) (yourself|urself|yourselves|your self)
1 (kys|kill ur self|go kys)
1 (go|just go|please go|you should|why dont you|you should just|go and|hurry up and|you had better) die
1 (go|please|just|just go|you should|why dont you|go and|you can|better) (jump off a bridge|jump off a cliff|jump off a roof|jump under a train|jump in front of a train|drop dead|end your life|drink bleach)
1 (drink|go drink|drink some) bleach
1 (end|take) your [own] [miserable|pathetic|worthless|sad|useless] life
1 jump off (a|the nearest|the) (bridge|cliff|roof|building)
1 (do us|do us all|do the world|do everyone|do everybody|do yourself) a (favour|favor) and (die|jump|quit|leave|disappear|hang|drop dead|end|kill|drown)
1 the world (is|would be|will be|would be a) (better|better off|better place) without you
1 (nobody|no one|noone) (would miss|will miss|likes|loves|wants|would mourn|needs|cares about|would care about) you
1 (nobody|no one) would (notice|care|cry) if you (died|vanished|disappeared|were dead|were gone)
0.6 (nobody|no one) would (notice|care|cry)
1 i hope you (die|burn|suffer|choke|rot|get cancer|get fired|get hit|bleed|drown|lose everything|get raped|get shot|never wake up)
1 (rot|burn) in hell
1 (you|you should|you can|you ought to) (die|burn) in a fire
1 (you deserve to|you need to|you must|you will|you are going to|you should) (die|suffer|bleed|be shot|be killed|be hanged|be raped|be beaten|be put down)
1 (you will|you are going to|youll) (regret this|pay for this|be sorry) [you] ({I}|{J})
1 you (do not|dont|didnt|did not) deserve to (live|exist|breathe|be alive)
1 you should (be ashamed of being alive|never have been born|have been aborted|have been swallowed)
0.6 {WILL} find (you|out who you are|out where you live)
1 {WILL} (hunt you down|come for you|make you suffer|make you bleed|make you pay|make you beg|track you down|find you and|end you|ruin your life|finish you)
1 {WILL} {HARM} (you|your family|your kids|your children|your mother|your wife|your sister|your daughter)
1 {WILL} (rape|murder|stab|strangle|butcher|castrate|torture) (him|her|them all|everyone)
1 (break|smash|crush|slit|wring|snap|bash|kick|punch|rip out|tear off|cut off|cut|bash in|kick in|knock out|stomp|smash in|carve up|cave in|shatter) your {BODY}
1 [and] i (know|found out|know exactly) where (you|your family|your kids|your children) (live|lives|sleep|work|park|go to school)
1 (watch your back|sleep with one eye open|you are dead|you are a dead man|youre dead|your days are numbered|you wont see the next)
0.6 (next time i see|when i see|if i ever see|if i catch|once i find|when i find) (you|him|her|your face)
1 (next time i see|when i see|if i ever see|if i catch) you (i will|ill|i ll|you will|you are dead)
1 (put|putting) (you|him|her) (out of his|out of her|out of your|out of our|down like) (misery|a dog)
0.6 (out of our misery|put (him|her) down)
0.5 (somebody|someone|anybody) (should|ought to|has to|must|needs to) (put|shoot|hit|slap|hang|beat|punish|lock|teach|finish|silence|break|smash)
1 (smash|punch|break|bash|cave in|kick in|slap|rearrange) (that|his|her|their) (ugly|stupid|fat|smug|dumb|fucking) (face|head|skull|mouth|nose|teeth)
0.4 (the team|we|they|everyone|everybody|we all) (will be|would be|is|are) (fine|better|better off|happier) without you
0.6 (make|making) (him|her|them|you|somebody|someone|whoever) (pay|bleed|regret|suffer|cry|beg) for
1 (has|have|having|got|with) the (brain|brains|iq|intelligence|intellect) of (a|an) [dead|rotten|half dead|retarded] {BEAST}
1 (dumber|stupider|dumber even|more stupid|thicker) than (a|an) [dead|rotten|bag of] {BEAST}
0.6 (brain|brains) of a
1 (as|so) (dumb|stupid|thick|dense) as (a|an) [bag of] {BEAST}
1 you (are|must be|look|sound|were born) [so|too|really|just|truly|as|that|fucking] (stupid|dumb|retarded|braindead|brain dead|subhuman|disgusting|worthless|pathetic|a disgrace|mentally ill|useless|ugly|brainless|scum|trash|garbage|vermin)
1 are you (really|actually|honestly|truly) [that|so|this] (dumb|stupid|dense|thick|retarded)
1 are you (that|so|this) (dumb|stupid|dense|thick|retarded)
1 are you (retarded|braindead|brain dead|fucking stupid|fucking kidding me you|mentally ill|mentally retarded)
1 (too|so) (stupid|dumb|thick|retarded) to (live|breathe|read|code|exist|understand english|tie|be allowed|hold|write)
0.6 (too|so) (stupid|dumb|thick) to
1 you (disgust me|make me sick you|make me want to vomit|are a disgrace to)
0.5 you make me sick
1 (everyone|everybody|the whole team|we all|all of us) (hates|hate|despises|despise|laughs at|is sick of) you
1 (i hate you|i despise you|i loathe you)
1 your (mother|mom|mum|parents|father|family) (is a whore|should have|must be ashamed|must be so ashamed|regret|regrets|was a whore|must regret|are ashamed)
1 (crawl|go) back (under|to|into) (your|the|that|whatever) (rock|hole|cave|sewer|gutter|hole you)
1 (with|find his ass with|find their ass with|find your ass with) both hands and a (map|torch|flashlight|guide)
1 if (brains|intelligence|stupidity|stupid) were
1 (even|than) a trained (monkey|ape|dog|chimp|seal) (could|would|can)
0.6 a trained (monkey|ape|dog|chimp)
1 (waste|wasting) of (oxygen|space|skin|air|sperm|a human being)
0.6 (kept|keep) (away from|off) (keyboards|a keyboard|computers|any keyboard)
1 (i will|ill|lets|we will|gonna) (drag|throw|kick) you out by (your|the) (hair|neck|ears|throat|balls)
1 (du|so ein|was für ein|was fuer ein|du bist ein|du bist eine|du bist der größte|du verdammter|du verdammtes|du dummer|du dumme|du blöder|du fettes|du dreckiger|du elender|du elendes|du kleiner|du kleine|du mieser|du beschissener) {IDE}
1 (ist ein|ist eine|ist so ein|ist ein echter|ist ein totaler|sind alle|seid ihr|ihr|sie|sind doch|nur ein|welcher|verdammter|verdammtes|dieser|dieses|diese) {IDE}
1 (hurensohn|missgeburt|arschloch|drecksau|wichser|vollidiot|hurensöhne|arschlöcher|wichsfresse|fotze)
1 (fick dich|fick deine mutter|fickt euch|verpiss dich|verpisst euch|verrecke|verreck doch|leck mich am arsch|leck mich|halt die fresse|halt deine fresse|halts maul|halt dein maul|halt die klappe du|geh sterben|stirb|stirb endlich|bring dich um|häng dich auf|erschiess dich|spring von der brücke|dich sollte man|du gehörst erschossen|du gehörst weggesperrt)
1 (ich|wir) (bringe|bring|mach|mache|schlage|schlag|steche|stech|finde|breche|brech|bringen|machen|schlagen|kriege) (dich um|dich fertig|dich kalt|dir die fresse ein|dich ab|dich und|dir die beine|dir alle knochen|dir die finger|dich zusammen|dir den schädel ein|dich tot|dir das genick)
1 (ich weiss|ich weiß|wir wissen) wo du wohnst
1 (so dumm|so blöd|dumm wie|dümmer als|zu dumm|zu blöd|zu dämlich) (wie du|kann man|brot|stroh|ein stück brot|zum|um zu atmen|um zu leben|fürs)
0.6 kann man (gar|doch gar|doch|eigentlich gar) nicht sein
0.5 (verschwinde|hau ab|hau bloß ab|verzieh dich|schäm dich)
1 du bist (so dumm|so blöd|das letzte|dumm|zu dumm|strohdumm|hässlich|krank im kopf|behindert|zu nichts zu gebrauchen|abschaum|dreck|müll|wertlos|eine schande|ekelhaft)
1 (tu es|t es|vous êtes|il est|elle est|est|tu n es|quel|quelle|ce sont|sont) [un|une|vraiment un|qu un|qu une|des|un vrai|un gros|un sale|un pauvre|une grosse] {IFR}
1 (espèce de|espèce d|sale|gros|grosse|pauvre|petit|petite|bande de|un vrai|tas de|tous des|foutu|putain de) {IFR}
1 (tu es|t es|vous êtes|tu n es|espèce de|pauvre|bande de|tas de) [un|une|qu un|qu une|vraiment un|un vrai|un gros|un pauvre|un sale] {JFR}
1 (connard|connasse|enculé|encule|salope|fils de pute|enfoiré|connards|enculés|salopard)
1 (ferme ta gueule|ta gueule|ferme la|va te faire foutre|va te faire enculer|va te faire|va te faire mettre|allez vous faire foutre|va mourir|va crever|crève|nique ta mère|nique ta race|nique toi|casse toi pauvre con|dégage connard|va te pendre|suicide toi|tue toi|pends toi|va en enfer|je te pisse dessus|mange tes morts)
1 je vais (te|vous) (tuer|crever|buter|casser la gueule|péter la gueule|défoncer|égorger|massacrer|casser les|briser les|retrouver|violer|démolir|étrangler|faire la peau|saigner)
1 je sais où tu (habites|vis|dors)
1 (t es|tu es|tu es trop|t es trop|tu es tellement|tu es vraiment|t es vraiment) (débile|stupide|trop con|con|bête|nul|inutile|moche|répugnant|une merde|une honte|la honte de|un déchet|dégueulasse)
1 (eres|es|sos|usted es|son|serás) [un|una|unos|unas|tan|muy|tremendo|un maldito|un puto|un pedazo de|un completo|un verdadero] {IES}
1 (maldito|maldita|puto|puta|pedazo de|pinche|cállate|sucio|sucia|asqueroso|asquerosa|menudo|so|banda de|grandísimo) {IES}
1 (eres|sos|usted es|pedazo de|serás|cállate) [un|una|tan|muy|un maldito|un pedazo de|una puta|un completo] {JES}
1 (gilipollas|hijo de puta|hija de puta|hijos de puta|hijueputa|imbécil de mierda|idiota de mierda|cabrón de mierda|pendejo|pendejos|malparido)
1 (vete a la mierda|véte a la mierda|vete al infierno|que te jodan|jodete|jódete|que te den|que te den por culo|chinga tu madre|chingate|chupame|muérete|muerete|púdrete|ojalá te mueras|ojala te mueras|mátate|matate|suicídate|cierra la boca|cierra el pico|cállate la boca|la puta que te parió|la concha de tu madre|tu puta madre|me cago en tu|pégate un tiro|ahórcate)
1 (te voy a|voy a|os voy a|vamos a) (matar|matarte|romper la cara|romperte|romper los|romper las|partir la cara|partirte la cara|partir|reventar|violar|violarte|encontrar y|degollar|apuñalar|hacer sufrir|buscar y|dar una paliza|destrozar|cortar|enterrar)
1 sé donde (vives|duermes|trabajas)
1 (seu|sua|seus|suas|és|você é|vc é|tu és|é|ele é|ela é|vocês são|são|bando de|maldito|maldita|cala a boca) [um|uma|uns|muito|um grande|um completo|uma grande|um maldito|um verdadeiro|um bando de] {IPT}
1 (seu|sua|você é|vc é|tu és|és|vocês são|cala a boca|pedaço de) [um|uma|uns|muito|um grande|um completo|um pedaço de|tão] {JPT}
1 (filho da puta|filha da puta|filhos da puta|arrombado|cuzão|desgraçado|vagabunda|otário de merda|idiota de merda)
1 (vai se foder|vai te foder|vá se foder|vai tomar no cu|vai tomar no rabo|vai pro inferno|vai para o inferno|vai à merda|vai a merda|vai morrer|morre|morra|se mata|mata te|se enforca|cala a boca|cala essa boca|fecha a matraca|puta que te pariu|puta que o pariu|foda se você|vai pro caralho|vai para o caralho|vai tomar no olho)
1 (eu vou|vou|vamos) (te matar|matar te|matar você|te quebrar|quebrar a tua cara|quebrar a sua cara|te arrebentar|te encher de porrada|te estuprar|te achar|te encontrar e|acabar com você|acabar contigo|partir te a cara|quebrar os seus|quebrar seus|te esfaquear|te degolar|arrancar)
1 (eu sei|sei) onde (você mora|tu moras|você dorme)
1 (ты|вы|такой|такая|какой|какая|ну ты|ты же|ты просто|ты полный|ты тупой|ты тупая|ты конченый|тупой|тупая|тупое|полный|конченый|грязная|грязный|жирная|жирный|этот|эта|он|она|вот|ах ты|старый|старая|ебаный|ебаная|сраный|проклятый|заткнись|пошёл вон|последняя|последний|безмозглый|редкостный|вонючий|мерзкая|ленивая|ленивый|лживый) {IRU}
1 (заткнись|заткни пасть|закрой рот|закрой пасть|пошёл ты|пошел ты|пошла ты|пошёл нахуй|пошел нахуй|пошел на хуй|пошла нахуй|иди на хуй|иди нахуй|на хуй|нахуй иди|иди в жопу|пошёл в жопу|сдохни|чтоб ты сдох|чтоб ты сдохла|сдохните|убей себя|убейся|повесься|вали отсюда|проваливай|отъебись|отвали|ебать тебя|соси|ебал я|ублюдок|мразь|тварь|твою мать|ёб твою мать|шлюха|чмо|гандон|долбоёб|сучка|мудак|пидорас)
1 (я тебя|я вас|мы тебя|тебя) (убью|найду|прикончу|зарежу|закопаю|порву|урою|изнасилую|придушу|прибью|убьём|уничтожу|грохну|достану|найдём|надо убить|повешу)
1 (сломаю|переломаю|оторву|разобью|отрежу|сломать|вырву|выбью|сверну|размажу|набью|проломлю) (тебе|твою|твои|ему|ей|вам|шею|руки|ноги|пальцы|голову|морду|зубы|башку)
1 я знаю где ты (живёшь|живешь|спишь)
1 (руки из жопы|безрукий дебил|мозгов как у|мозги как у|тупой как|тупее чем|ты тупой|ты тупая|ты никто|ты позор|ты ошибка природы|ты отвратителен|тебе место в психушке|лучше бы тебя не было|лучше бы ты не родился|ты ничего не стоишь)
1 (你|你这|你这个|你就是|你就是个|你就是一个|你是|你是个|你是一个|你们这些|你们这群|你们都是|这个|这帮|这群|一群|真是个|就是个|他是个|他就是个|她是个|哪个|哪来的|死|臭|大|都是|滚|闭嘴|去你的|简直是个|纯) {IZH}
1 (傻逼|煞笔|沙比|操你妈|草泥马|操你|肏你|日你妈|日你|你妈的|他妈的你|去你妈|你妈逼|滚蛋|滚开|滚出去|混蛋|王八蛋|狗娘养的|婊子|贱货|贱人|脑残|智障|弱智|去死|去死吧|怎么不去死|你去死|死全家|你全家|不得好死|闭嘴吧你|吃屎|蠢得像|猪脑子|脑子进水|脑子有病|你有病吧|丢人现眼的东西|废物东西|没脑子|狗屁不懂|生儿子没屁眼)
1 (我要|我会|我一定|老子|我早晚) (杀了你|弄死你|打死你|砍死你|砍了你|宰了你|找到你|打断你|掐死你|揍死你|干掉你|强奸你|剁了你|扒了你|灭了你|让你死)
1 (打断|砸断|拧断|剁掉|砍断|打爆|割断|掰断)(你的|你)(手|腿|脖子|头|手指|狗头|喉咙|脑袋|狗腿)
1 (我知道你住|我知道你家)
1 (お前|おまえ|あんた|てめえ|てめぇ|貴様|きさま|あいつ|こいつ|この|この野郎|本当に|書いた奴|書いたやつ|書いた人|レビュアー|担当者|作者) [は|も|って|みたいな|の|ら|らは|は本当に|は完全な|はただの|という] {IJA}
1 {IJA}(野郎|め|が|かお前|じゃないの|が書いた|は黙れ|は死ね|は消えろ|は帰れ|しかいない|ども|女|男|だろお前|にもほどがある)
1 (死ね|しね|氏ね|くたばれ|消えろ|失せろ|黙れ|馬鹿野郎|バカ野郎|ばか野郎|クソ野郎|くそ野郎|クズ野郎|糞野郎|ゴミ野郎|ぶっ殺す|ぶっ殺し|ぶん殴る|殺してやる|殺すぞ|殴るぞ|首を吊れ|自殺しろ|地獄に落ちろ|生きる価値|生きてる価値|生まれてこなければ|息をするな|二度と来るな|くそったれ|ふざけんなボケ|頭おかしい|頭が悪すぎ|脳みそ腐|脳みそが|お前の家を知って|住所は知って|クソ女|くそ女|クソババア|クソガキ)
"""

HATEFUL = """
1 {SLUR}
1 {SLUR}s
1 (you|you are a|you fucking|you dirty|you filthy|you stupid|fucking|filthy|dirty|stupid|typical|goddamn|bloody|lazy|you are such a|ugly) {FRAMED}
1 (kill all|kill the|i hate|hate|no|fucking|filthy|dirty|stupid|gas the|all|you) {FRAMED}s
1 {FRAMED}s (are|should|must|out|go home|get out|deserve|not welcome|cant|cannot|everywhere|stink)
1 {G} are [all|just|nothing but|fucking] (scum|filth|garbage|rats|pigs|dogs|cockroaches|a plague|a cancer|criminals|rapists|terrorists|stupid|too stupid|idiots|disgusting|worthless|not human|not people|less than human|vermin|animals|parasites|subhuman|inferior|trash|a disease|thieves|liars|monkeys|apes|savages|a virus|the problem|perverts|sick|mentally ill|evil|lazy|dirty|filthy|dumb|morons|invaders|leeches|lesser|degenerates|weak|worthless|whores|sluts|genetically inferior|a curse|retarded|insects|pests|maggots)
1 {G} (should|must|have to|need to|deserve to|ought to) (die|be killed|be shot|be gassed|be hanged|be deported|be exterminated|be banned|go back|not be allowed|never be allowed|be sterilised|be sterilized|be locked up|be burned|burn|be removed|be wiped out|be eliminated|be put down|leave|stay home|stay in the kitchen|be enslaved|disappear|go home|not vote|not exist|be castrated|hang)
1 {G} (do not|dont|don t) (deserve to live|deserve rights|deserve to exist|belong here|belong in|belong|have brains|have a soul|deserve|have souls)
1 {G} (go home|get out|out|go back to|cannot code|cant code|can t code|cannot program|cant program|cannot think|cant think|cant drive|belong in the|belong in|belong behind|breed like|ruin everything|ruin every|destroy everything|stink|smell|have no place|are not welcome|not welcome|cannot be trusted|cant be trusted|not allowed|control the media|control the banks|run the banks|rule the world|are taking over|are ruining|are destroying|only want our money|are to blame|steal|rape|infest)
1 (death to|death to all|gas|gas the|gas all|exterminate|exterminate the|exterminate all|fuck|fuck the|fuck all|fucking|filthy|dirty|stupid|hate|we hate|i hate|i despise|i cant stand|hate the|hate all|kill|kill the|kill all|kill all the|shoot all|shoot the|hang the|hang all|burn the|burn all|get rid of|get rid of all|get rid of the|send all|send all the|send the|deport|deport all|deport the|ban all|no more|wipe out|wipe out the|wipe out all|down with|keep|typical|lazy|damn|goddamn|disgusting|evil|those filthy|those dirty|these filthy|these dirty|exterminate these|stop hiring|never hire|never trust|do not hire|dont hire) {G}
0.4 {G} (back|out of|near|here|in our|in this|touch|are the reason|are why|like you|like her|like him|wrote)
0.4 (these|those|by|from|until they let|when you let|letting|let|let the|by the|blame|because of) {G}
0.6 (too stupid|too dumb|too weak|not made for|genetically|parasites|vermin|scum|subhuman|filthy animals|dirty animals|inferior race|lesser beings|not even human|crawled out of|savages|their brains|their kind|small brains|no brains)
0.6 (ruin every|ruin this|have no place|no place in|not welcome|infest|out of our country|out of this country|back where they came from|back to where they|do not belong|dont belong|get out of our|belong in cages|belong in the kitchen|belong in camps|breed like rats|breed like rabbits|breed like|are taking our|taking over our|stealing our|will be clean|clean again|pure again)
0.6 (get rid of them|rid of them all|send them back|deport them|throw them out|ban them all|kick them all out|lock them all up|keep them out|gas them|shoot them all|hang them all|burn them all|sterilise them|exterminate them|wipe them out)
0.6 (refuse to|never|will not|wont|do not|dont|not going to) (review|merge|work with|accept|take|trust|hire|read|run|touch) (code|patches|a patch|anything|commits|pull requests|with|work|orders)
0.6 (dont bother|do not bother|need not apply|not wanted here|stay away from|stay out of|keep your hands off|not your kind)
0.6 (this is|thats|that is) what (happens|you get|we get) (when|if|for)
1 (we|i) (do not|dont|never) (need|want|hire|trust|like|employ) [any|more] {G}
1 (only|just) [merge|take|accept|want|trust|need|review] [patches|code|commits|people|men] from (real men|white men|white people|whites|aryans|pure)
1 (white power|heil hitler|sieg heil|hitler was right|gas chambers now|white genocide|race war now|pure white race|ethnic cleansing now|master race|inferior race|race traitor)
1 (they|those people|these people|that kind|their kind|your kind|your people|people like that|this race|that race) (are|is|are all) (subhuman|vermin|animals|scum|parasites|filth|a plague|a disease|inferior|rats|cockroaches|not human|trash)
1 (go back to|get back to) (your country|where you came from|africa|your own country|mexico|china|india|the kitchen|your kitchen|the jungle|your jungle|your cave|your desert)
1 (a woman|women|girl|a girl|females) (belongs|belong) (in the kitchen|at home|behind the stove|on her knees)
1 {DE} (sind|sind alle|sind nur|sind doch|sind doch alle) (ungeziefer|parasiten|abschaum|dreck|müll|tiere|ratten|untermenschen|minderwertig|eine plage|eine seuche|zu dumm|dumm|verbrecher|schweine|affen|krank|pervers|faul|schmarotzer|kriminelle|kein mensch|keine menschen|zu blöd|wertlos|abartig|eine krankheit|ein krebsgeschwür|pack|gesindel|schädlinge|vergewaltiger)
1 {DE} (raus|gehören vergast|gehören abgeschoben|gehören an den herd|gehören in die küche|gehören nicht hierher|gehören weggesperrt|gehören erschossen|gehören ins lager|sollen sterben|sollten sterben|sollen verschwinden|verrecken|müssen weg|müssen sterben|sollen verrecken|können nicht programmieren|können nicht denken|haben hier nichts|stinken|vergasen|abschieben|haben hier nichts zu suchen|an den herd|nach hause)
1 (ich hasse|ich hasse alle|ich hasse diese|tod den|tod allen|scheiss|scheiß|dreckige|dreckigen|alle|verdammte|keine|blöde|dumme|faule|stinkende|typisch|drecks|diese scheiss|diese dreckigen|vergast die|vergast alle|tötet alle|erschiesst alle|weg mit den|raus mit den) {DE}
1 (dieses pack|dieses gesindel|ausländer raus|juden raus|sieg heil|heil hitler|deutschland den deutschen|drecksjude|drecksjuden|scheissausländer|scheißausländer|drecksausländer|scheissneger|umvolkung)
1 {FR} (sont|sont tous|sont toutes|ne sont que|c est) (de la vermine|des parasites|des animaux|des rats|des chiens|des déchets|des ordures|des sous hommes|une maladie|une plaie|inférieurs|trop bêtes|trop stupides|des singes|des voleurs|des criminels|des terroristes|des porcs|une peste|de la racaille|de la merde|dégoûtants|des cafards|un cancer|des violeurs|inférieures|des putes|des malades|stupides|bêtes|idiotes|incapables)
1 {FR} (doivent mourir|devraient mourir|dehors|à la cuisine|à la porte|au four|doivent partir|doivent crever|n ont rien à faire|puent|volent|ne savent pas coder|ne savent pas programmer|chez eux|hors de|nous envahissent|ne devraient pas)
1 (je hais les|je déteste les|je hais tous les|mort aux|mort à tous les|il faut tuer les|il faut expulser les|il faut virer les|tuez les|tuez tous les|brûlez les|putain de|saloperie de|ces sales|sales|sale|y en a marre des|trop de|dehors les|expulsez les|gazez les) {FR}
1 (sale) (juif|arabe|noir|nègre|négresse|pédé|gouine|musulman|chinois|gitan|immigré|étranger|race|youpin|bougnoule|tapette|rom|turc|femme|bicot)
1 {ES} son [todos|todas|una|unos|unas|puros|pura|solo] (basura|escoria|parásitos|animales|ratas|perros|plaga|enfermedad|inferiores|subhumanos|estúpidos|estúpidas|demasiado estúpidos|cerdos|criminales|ladrones|terroristas|monos|una plaga|una enfermedad|cáncer|vagos|delincuentes|violadores|putas|cucarachas|demasiado tontas|tontas|tontos|inútiles|bestias|asquerosos)
1 {ES} (deben morir|deberían morir|fuera de aquí|fuera|a la cocina|no deberían|no saben programar|no pueden programar|que se vayan|apestan|nos roban|nos invaden|merecen morir|no son humanos|no son personas|deben irse|a su país|a la hoguera|al horno)
1 (odio a|odio a todos|muerte a|muerte a todos|hay que matar a|hay que matar a todos|hay que expulsar a|hay que echar a|maten a|matar a|malditos|putos|asco de|quemar a|fuera|fuera todos|echen a|gasear a) {ES}
1 (malditos|malditas|putos|putas|sucios|sucias|asquerosos|pinches|mugrosos|moro|negro|judío|sudaca|gitano|indio|maricón|chino|panchito) [de] (inmigrantes|negros|judíos|moros|gitanos|musulmanes|gays|maricones|mujeres|extranjeros|sudacas|indios|chinos|mexicanos|mierda|migrantes|refugiados|árabes)
1 {PT} são [todos|todas|uma|uns|umas|só] (lixo|escória|parasitas|animais|ratos|vermes|praga|doença|inferiores|burros|burras|macacos|ladrões|criminosos|terroristas|porcos|uma praga|uma doença|câncer|bandidos|vagabundos|estúpidos|estúpidas|subumanos|nojentos|estupradores|putas|baratas|preguiçosos|bichos|bestas)
1 {PT} (devem morrer|deveriam morrer|fora daqui|fora|na cozinha|para a cozinha|não sabem programar|não deviam|não deveriam|têm que morrer|tem que morrer|merecem morrer|que voltem|fedem|não prestam|não são gente|não são humanos|voltem para|para o forno|roubam)
1 (odeio|odeio todos|morte a|morte a todos|morte aos|matem|matem todos|é preciso matar|temos que expulsar|malditos|malditas|fora com|fora|expulsem|queimem|nojo de|gás para) {PT}
1 (preto|judeu|viado|cigano|muçulmano|nordestino|imigrante|gay|árabe|chinês|índio|macaco|bicha|mulher) (de merda|imundo|nojento|burro|safado|fedorento|do caralho)
1 (imigrantes|judeus|negros|gays|muçulmanos|ciganos|estrangeiros|refugiados) (fora|são lixo|vão embora|para fora)
1 {RU} [это|все|все они|просто|же|всегда] (паразиты|животные|мусор|грязь|крысы|зараза|недочеловеки|не люди|тупые|слишком тупые|твари|обезьяны|скот|воры|преступники|террористы|свиньи|чума|болезнь|уроды|быдло|мразь|звери|тараканы|больные|извращенцы|насильники|вырожденцы|дикари|отбросы|ленивые|низшая раса)
1 {RU} (должны умереть|должны сдохнуть|вон|вон из|валите домой|валите|убирайтесь|на кухню|не умеют программировать|не умеют думать|не могут|воняют|нас захватили|прочь|в печь|надо убивать|надо выгнать|место на кухне|должны сидеть|не нужны|понаехали|не должны)
1 (смерть|ненавижу|ненавижу всех|все|бей|убивать|убить всех|проклятые|грязные|вонючие|тупые|долой|всех этих|гнать|вешать|сжечь всех|гони|эти поганые|поганые|очередные) {RU}
1 (понаехали|понаехавшие|бей жидов|бей хачей|смерть хачам|россия для русских|грязные чурки|чурки|чурок|бабам место|бабам нельзя|баба за рулём|чёрные твари|жидомасоны|ненавижу мигрантов|ненавижу евреев|ненавижу геев|ненавижу женщин|смерть евреям|смерть мусульманам|мигрантов вон|чурок вон|всех мигрантов)
1 {ZH}(都|全|就)(是|该|不是|没)(垃圾|寄生虫|畜生|害虫|老鼠|蠢货|死|人|废物|贼|骗子|猪|狗|病毒|罪犯|恐怖分子|低等|劣等|笨|蠢|蟑螂|强奸犯|蛆|瘟疫|渣滓|变态|神经病|低能|懒鬼|祸害|脑子)
1 {ZH}(是|真|太|又|又懒又)(垃圾|寄生虫|蠢货|害虫|恶心|蠢|笨|脏|畜生|废物|劣等|低等|低贱|懒|臭|丑|老鼠|渣)
1 {ZH}(不是人|去死|滚出去|滚回去|滚|不配|就该死|都该死|都去死|不该|没脑子|不会编程|不会写代码|只配|就应该|应该被|必须死|滚出|写不出|的脑子)
1 (杀光|杀死|灭绝|消灭|赶走|赶出|我讨厌|我恨|讨厌|恨死|死|臭|该死的|肮脏的|恶心的|烧死|毒死|干掉|禁止|最恨|又是|打倒)(所有|那些|这些|全部|这帮|这群)?{ZH}
1 {JA}は(ゴミ|クズ|寄生虫|害虫|動物以下|劣っている|馬鹿|バカ|死ね|出て行け|帰れ|消えろ|人間じゃない|人間ではない|犯罪者|泥棒|猿|サル|豚|ゴキブリ|病気|汚い|劣等|無能|頭が悪い|邪魔|皆殺し|みんな死ね|台所に|プログラミングに向いて|コードを書くな|信用できない|下等|臭い|いらない|黙って|嘘つき|テロリスト|怠け者|害悪|国に帰れ|家にいろ|能力が低い|虫けら)
1 {JA}(を殺せ|を追い出せ|が嫌い|なんか|どもは|ども|に死を|は全員|のくせに|を排除|を駆除|を皆殺し|は皆|を入れるな|には無理|だから無理|出て行け|帰れ|消えろ|死ね)
"""

SEXUAL = """
1 (suck|lick|ride|stroke|touch|choke on|sit on|taste|swallow|gag on|kiss|jerk) my (dick|cock|penis|balls|ass|pussy|tits|nipples|face|nuts|clit|shaft|rod|thick cock|big cock|hard cock|fat cock|big dick|hard dick|asshole)
1 (my|his|the|a|your|big|hard|huge|thick|throbbing|wet|her|erect) (big|hard|huge|throbbing|thick|massive|rock hard|stiff|dripping|wet|tight|juicy|naked|swollen) (cock|dick|penis|pussy|tits|cunt|boner|erection|nipples|clit|boobs|ass)
1 (my|his) (cock|dick|penis|boner|erection) (is|gets|was|in|inside|into|deep|hard|got|so)
1 (her|your|nice|big|huge|great|small|those|sweet|perky|juicy|bare|fat|hot) (tits|titties|boobs|pussy|cunt|nipples|ass cheeks)
1 (eat|lick|fuck|finger|pound|taste|smell|fill|stretch|spread|destroy|wreck|see|shave) (your|her|that|my) (pussy|cunt|ass|asshole|tight ass|tight pussy|wet pussy|holes|hole|clit|sweet pussy)
1 (blowjob|blow job|handjob|hand job|rimjob|footjob|deepthroat|deep throat|gangbang|gang bang|cumshot|creampie|bukkake|fisting video|threesome|facesitting|titfuck|dildo up|buttplug|butt plug in|double penetration sex|orgy tonight|golden shower|cum dump|cumslut|cum slut|fuckbuddy|fuck buddy|sexting|dick pic|dick pics|dickpic|milf porn|hentai|rule 34 of you|upskirt|nudes for)
1 (jerk|jerking|jack|jacking|wank|wanking|rub one) off (to|over|on|while|thinking|in)
1 (i|i always|i often|i want to|i like to|lets|you make me|let me|to) (masturbate|wank|jerk off|jack off|orgasm|cum|ejaculate) [to|over|on|for|with|inside|in|all]
1 (masturbate|masturbating|wanking) (to|over|for|while|in front|thinking|on)
1 (i want to|i wanna|i am going to|im going to|im gonna|i am gonna|let me|i d love to|id love to|i would love to|dying to|i would|lets|i d like to|i long to) (fuck|bang|hump|shag|bone|undress|lick|spank|ravish) (you|her|him|your|u)
1 (fuck|shag|bang|hump|spank|undress|fist|sodomise|ride) (me|you|her) (hard|harder|all night|senseless|from behind|deeper|raw|silly|tonight|right here)
1 (fucked her|fucking her|fucked him hard|fuck my wife|fucks his|banged her|banging her|shagged her)
1 bend (over|you over|her over) [the|my|and|so|for|this|that|on] [desk|table|keyboard|i|i will|me]
1 (cum|come|jizz|ejaculate|sperm|squirt|spunk) (on|in|inside|into|over|all over|on to) (your|her|my|the) (face|tits|mouth|ass|pussy|boobs|chest|back|belly|keyboard|hair|tongue)
1 (make|made|making) (you|her|me|him) (cum|squirt|wet|moan|scream my name|orgasm|beg for it)
1 (so|i am|im|i m|feeling|getting|very|always|get|are you|hot and|wet and|drunk and|super|and) horny
1 horny (girls|women|wives|teens|milfs|moms|housewives|singles|men|boys|guys|girl|slut|wife|babes|and)
1 (free|watch|hot|live|hardcore|uncensored|amateur|teen|gay|lesbian|best|more|hd|new|homemade|rough|extreme|download) (porn|porno|sex cams|xxx cams|sex chat|sex videos|sex video|porn clips|porn videos|cam girls|sex tape|nude cams|sex movies|adult cams|camgirls|sexcam|hookups)
1 xxx (clips|videos|cams|movies|chat|pics)
1 (porn|sex) (clips|videos|video|cams|cam|movies|chat|tape|tube|site here|pics|hot|tonight|now|dating|hookup)
1 (send|sends|show|post|trade|share|give|want|got|need|sell|swap|have) [me|your|us|some|her|more|my|more of your] (nudes|nude pics|naked pics|naked pictures|nude photos|nude pictures|tits|boobs|pussy pics|dick pics|dirty pictures)
1 (naked|nude) (pictures|photos|pics|selfies|girls|teens|women|videos|babes|wife) [of|for|here|online|from|waiting]
0.6 (wet and naked|naked and wet|hot and wet|girls near you|women near you|singles near you|click here for|waiting for you tonight|only reason she got|only reason she is|why they hired her|because of her legs)
0.6 (feels like in bed|in bed with me|in my bed|in the shower|on my desk naked|on the desk|in my lap|on my lap|on your knees|between my legs|between your legs|between her legs|under the desk)
0.6 (hand|hands|fingers|tongue|lips) (goes|go|slides|slide|moves|move|slips|slip|wanders|wander|running|run) (lower|down|between|deeper|under|inside|up)
0.6 (want pictures|want pics|want to see pictures|want a video|pictures if you|pics if you|want to watch|take off your clothes|take it all off|thinking of you naked|moaning|panting|want to see more)
0.6 (i will|ill|let me|i want to|i can|i would love to) show you (what|how)
1 (looking for|want|wants|need|needs|love|like|had|have|having|enjoy|offer|for|into|up for|in for|about) (hard|rough|hot|anal|oral|wild|casual|kinky|group|phone|raw|dirty|steamy|no strings|great|discreet|unprotected|public) sex
1 (hard|rough|hardcore|kinky|dirty|wild|hot|steamy) sex (with|and|tonight|in|on|all|now|with me|with you|partner|at|toys|videos|party)
1 (have|having|had|want|wants|wanted|need) sex with (you|me|her|him|my|your|a|the|his|strangers|us)
1 (sex|fuck) (with you|with me|me now|you tonight|you all night|you on the|in the server room|on the desk|my brains|your brains|with my wife|my wife)
1 (i want|i need|i crave|i dream of|i fantasise about|i fantasize about|thinking of|thinking about|imagining) [ripping|tearing|having|taking|touching|licking|kissing|tasting] [off] (your naked body|your body|your lips on|you naked|your clothes off|you in my bed|your mouth on|your wet|you on the desk|your hot|your tits|your ass|your tight|her naked|her body|her tits|her ass|your skirt off)
1 (rip|ripping|tear|tearing|take|taking|strip|peel|pull|pulling) [off] (your|her|my) (clothes|panties|skirt|dress|blouse|bra|thong|underwear|pants) [off]
1 (touch|touching|play with|playing with|finger|fingering|pleasure|pleasuring|rub|rubbing) (yourself|myself|herself|your pussy|my pussy|her pussy|your clit|my cock|his cock) [for|while|and|under|until|in|with|on]
1 (i|we) (am|are|m|re) (so wet|dripping wet|rock hard|hard for you|wet for you|so hard for|dripping for|naked and)
0.7 (my wife and i|couple) (look|looking|are looking|want|seek|search) for a (third|woman|man|girl)
1 (quiero|voy a|deseo|me gustaría|quisiera|te voy a|vamos a|ganas de) (follarte|follar|cogerte|coger contigo|chuparte|metértela|metertela|lamerte|desnudarte|comerte el coño|comerte el cono|correrme|tocarte las tetas|meterte la polla)
1 (chúpame|chupame|mámame|mamame|cómeme|comeme|lámeme|lameme|tócame|tocame) (la polla|la verga|el coño|el cono|las tetas|la pinga|el culo|los huevos|el pito)
1 (follarte|tetas enormes|qué tetas|tus tetas|coño mojado|cono mojado|polla dura|polla grande|fotos desnuda|sexo duro|sexo anal|mujeres calientes|chicas calientes|porno gratis|mándame fotos desnuda|me la chupas|chupar mi polla|mamada)
1 (ich will|ich möchte|ich würde|lass uns|lass mich|ich werde|komm) (dich ficken|ficken|dich lecken|deine muschi|deine titten|mit dir schlafen du|deinen arsch|dich nackt|dich bumsen|dich vögeln|dir in den mund|dich durchficken|dich hart)
1 (blas mir einen|blas mir|lutsch meinen|leck meine|leck mir|fick mich|nimm mich hart|zeig deine titten|zeig mir deine|geile titten|geile muschi|feuchte muschi|harter schwanz|mein schwanz|meinen schwanz|meinem schwanz|dicke titten|nacktbilder|geile weiber|geile frauen|fick meine|dich ficken|gratis porno|kostenlose pornos|harter sex|geiler sex|arschfick|wichs vorlage|abspritzen auf|geile schlampen)
1 (je veux|je vais|j ai envie de|laisse moi|viens|je voudrais|envie de) (te baiser|te sucer|te lécher|baiser avec|te prendre|te sauter|te bouffer la chatte|te défoncer le cul|te niquer|jouir|te sodomiser|te déshabiller|coucher avec toi)
1 (suce ma bite|suce moi|suce ma queue|lèche ma chatte|ta chatte|ma bite|ma grosse bite|tes seins nus|gros seins|gros nichons|photos de toi nue|photos nue|tes nichons|bite dure|chatte mouillée|porno gratuit|sexe hard|sexe anal|femmes chaudes|baise moi|branle moi|me branler|plan cul|grosse queue)
1 (quero|vou|deixa eu|deixa me|adoraria|queria|vamos) (te foder|te comer|foder você|chupar|te chupar|meter em você|lamber|te lamber|gozar|te ver pelada|transar com você|comer esse cu|gozar na|comer você|meter|te pegar)
1 (chupa meu pau|chupa o meu pau|chupa minha|mama aqui|meu pau duro|meu pau|minha rola|minha pica|tua buceta|sua buceta|buceta molhada|peitos enormes|manda nudes|manda foto pelada|fotos pelada|sexo anal|sexo selvagem|gostosa pelada|mulheres quentes|pornô grátis|porno gratis|bater uma punheta|punheta|boquete|teus peitos|seus peitos)
1 (хочу|буду|давай|дай|мечтаю|хотел бы|приду и) [тебя|я тебя|себя] (трахнуть|трахнуть тебя|тебя трахнуть|выебать|отодрать|отсосать|трахаться|лизать|полизать|кончить|раздеть|ебать|поиметь|отлизать|потрогать твои сиськи|тебя выебать|тебя раздеть|секса с тобой)
1 (отсоси|соси мой|соси хуй|трахни меня|выеби меня|мой член|мой хуй|твоя киска|твои сиськи|мокрая киска|большие сиськи|пришли голые|пришли голое фото|голые фото|голые девушки|горячие девушки|бесплатное порно|порно онлайн|секс с тобой|жёсткий секс|анальный секс|минет|дрочу на|дрочить на|подрочи|трахал твою|кончил на|возьми в рот|сиськи покажи|трахнуть тебя)
1 (我想|我要|想|好想|让我|来|快)(操你|干你|上你|睡你|和你上床|跟你上床|舔你|摸你|脱光你|插你|日你|强奸你|跟你做爱|和你做爱|看你裸体|看你的裸照|肏你|射在你)
1 (做爱视频|裸聊|裸照|色情视频|黄色视频|免费黄片|成人视频|约炮|一夜情|口交|肛交|乳交|吃我的鸡巴|舔我的|大鸡巴|我的鸡巴|骚逼|骚货|小穴|淫水|奶子|大奶|湿透的|自慰给|打飞机给|射在|吸我的|高潮给|淫荡|无码|发裸照|裸体照片|含住我的|你的胸好大|看你的胸)
1 (やらせろ|やりたいだけ|セックスしたい|セックスしよう|エッチしよう|エッチしたい|犯したい|犯してやる|舐めたい|舐めて|しゃぶれ|しゃぶって|おっぱい|オナニー|フェラ|中出し|無修正|巨乳|まんこ|マンコ|ちんこ|チンコ|ちんぽ|チンポ|パイズリ|ハメ撮り|裸の写真|裸を見せ|ヌード写真|濡れ濡れ|勃起し|ザーメン|ぶっかけ|下着を脱|お前を抱きたい|抱かせろ|イかせ|乳首|股を開け|エロ動画|アダルト動画|素人動画)
"""

# Words that weigh little: they are also said of code, of oneself, or in medicine.
LIGHT = """
0.3 ({I})
0.2 (bastard|bitch|loser|scum|retarded|pathetic|worthless|stupid|dumb|braindead)
"""
# Swearing: said at code more than at anybody; counted beside an insult, not by number.
SWEARING = """
0.2 (fuck|fucking|shit|damn|crap|porn|goddamn)
"""

# Innocent uses: a hit wholly inside such a phrase, which stands as whole words of one sentence, does not count.
EXCEPTIONS = """
(i am|im|i was|i feel like|i must be|i look like) [such] (a|an) [stupid|complete] {I}
(i am|im|i was|i am so|i was so) (stupid|dumb|worthless|pathetic|braindead|retarded)
such (a|an) {I} (forgot|i forgot|of me|i am|i was|am i)
what (a|an) {I} (i am|i was|am i)
(my own|this is my) stupidity
[i am] (an|a) {I} (forgot|and forgot|sorry|i forgot|today)
(idiot proof|idiotproof|idiot light|idiot lights|idiot check|keep it simple stupid|stupid simple|stupid mistake|useful idiot|village idiot|bastard sword|bastard operator|bastard file|retarded by|be retarded|is retarded by|fire retardant|flame retardant|ignition timing may be retarded|spark is retarded|retarded timing)
(penetration test|penetration testing|rape seed|rapeseed|rape oil|sperm whale|sperm whales|blue tit|great tit|coal tit|blue tits|great tits|hooker and chain|nude colour|nude color|nude mouse|nude mice|bend over backwards|bend over backward|ass cheeks of a|pussy willow|pussy cat|pussycat|cock robin|cock and bull|weather cock|stop cock|dick cheney|moby dick|dick van|spotted dick|cum laude|magna cum laude|summa cum laude)
(profanity filter|hate speech|hate speech classifier|abusive comments|toxicity classifier|block porn|porn domains|porn filter|porn blocker|porn sites|block list|mark adult content|adult content|word list|wordlist|bad words|slur filter|blocked words|banned words|swear words|porn detection|nsfw filter|test strings for the filter|offensive words)
(breast cancer|oral sex as a risk factor|anal sex as a risk factor|have sex with men|had sex with men|sex with men|sexual health|sex column|sex field|health survey|sex education|sex ratio|sex chromosome|sex with|safe sex|the sex of)
(kill (yourself off|orphaned child|the process|child processes|all children|your process|your session|your jobs|your own process|your container))
(beat you to it|hang yourself in a loop|shoot yourself in the foot|shoot ourselves in the foot|shot yourself in the foot|you shoot yourself in the foot|hurt yourself|bash your|cut your losses|break your build|break your neck over|break your head over|snap your fingers|cross your fingers|burn your fingers|get your hands dirty|kick your teeth)
(i will kill you not|to kill you process|i should kill your process|we will end your session|i will cut your branch|we will burn your)
(dead man switch|dead mans switch|you are dead in the water|watch your back pressure)
(cracker barrel|cracker dataset|christmas cracker|salted crackers|crackers are|coon hound|maine coon|raccoons|spic and span|spick and span|homo sapiens|homo erectus|jap air|wops|kraut rock|queer theory|queer studies|abo blood|abo group|abo blood group|gypsy moth|gypsy jazz|jew harp|jews harp|dyke marches|dykes and|savage worlds|noble savage|negro spirituals|negro leagues|rio negro|chink in the armour|chink in the armor)
(by women|by girls|from women|from the chinese|these women|those women|keep women safe|keep girls safe|let women|by foreigners|by immigrants|by refugees|by asians|by africans|by indians|by christians|by roma|let girls|no more women only|keep women|keep girls)
(master slave|black list|white list|blacks and whites|typical whites|whites are|blacks are|the blacks and|the blacks|the whites|fsck|roma are|poles are|the poles|poles out)
(ist ein opfer|das opfer|die opfer|dieses opfer|der penner|ihr opfer|sie opfer)
(é um animal|que animal|são animais|grande animal|es un perro|es basura|es una mierda|es mierda|es inútil|es muy tonto|es un burro|é lixo|é inútil|é um lixo|é uma merda|é merda|são lixo|é estúpido|que merda|que bosta|é uma bosta|é bosta|que lixo|qué mierda|qué basura|menuda mierda|vaya mierda|puta mierda|maldito bug|esta mierda)
(putain de merde|c est de la merde|est une merde|c est con|est con|trop con|est idiot|c est idiot|est débile|c est débile|est stupide|quelle merde|quel con je suis|est minable|un vrai con je)
(вот говно|это говно|этот говно|вот блядь|этот гад|полный говно|этот козёл|такой баран|вот сука)
(这个垃圾|这个垃圾回收|都是垃圾|就是个垃圾回收|大垃圾|一群猪)
"""
