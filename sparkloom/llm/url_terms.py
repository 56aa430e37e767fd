"""The default vocabulary of the URL filter: general terms of spam, gambling, pornography and malware, with their inflected forms.

A strict term alone rejects a URL; soft terms have weights, as many of them are found in good URLs too.
"""

STRICT = tuple(
    """
    porn porno porns pornhub porntube pornstar pornstars xxx hentai milf milfs creampie blowjob blowjobs camgirl camgirls sexcam sexcams
    livesex freesex sextube nudes upskirt bukkake gangbang hardcoresex casino casinos onlinecasino casinobonus freespins slotmachine
    slotmachines sportsbook sportsbooks warez keygen keygens crackz cracked-software serialz nulled malware spyware ransomware adware
    phishing phish trojan botnet torrent torrents thepiratebay viagra cialis levitra tramadol xanax cheap-pills payday-loans payday-loan
    paydayloan paydayloans free-money spam-farm linkfarm link-farm doorway-page replica-watches replicawatches escort-service
    escortservice escorts-service get-rich-quick
    """.split()
)

_BY_WEIGHT = {
    2: """
    sex sexy sexual nude nudity naked erotic erotica adult adults fetish escort escorts webcam webcams strip stripper strippers gambling
    gamble gambler bet bets betting poker roulette blackjack jackpot jackpots slot slots lottery lotto spam spammer spammy crack cracks
    cracked serial hack hacks hacked cheat cheats pill pills pharmacy pharmacies steroid steroids replica replicas payday warranty-claim
    """,
    1: """
    free cheap cheapest discount discounts bonus bonuses win wins winner winners winning prize prizes promo promos promotion promotions
    coupon coupons deal deals offer offers sale sales buy order click clicks clickhere visit signup register loan loans credit credits
    debt mortgage insurance refinance cash money earn earning earnings income profit profits rich invest investing forex bitcoin crypto
    airdrop giveaway gift gifts reward rewards download downloads install setup mirror dating date singles chat hot girls teen teens
    babes cam cams video videos tube stream streaming weight diet slim fat detox pharma meds drug drugs prescription farm seo backlink
    backlinks traffic ads popup redirect track tracker affiliate referral guaranteed miracle secret exclusive limited urgent
    """,
}
SOFT = {term: weight for weight, terms in _BY_WEIGHT.items() for term in terms.split()}
SOFT_LIMIT = 3
