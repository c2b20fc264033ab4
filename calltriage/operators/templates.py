"""Scenario families for made-up calls: phrasings by turn, and values for their slots."""

from __future__ import annotations

from dataclasses import dataclass

CALLER, RECEIVER = "Caller", "Receiver"


@dataclass(frozen=True)
class Family:
    """``turns``: (speaker, phrasings) in order; label 1 is a scam."""

    name: str
    scam_type: str
    label: int
    turns: tuple[tuple[str, tuple[str, ...]], ...]


#: Values for the slots of all families.
POOLS = {
    "name": ("Asha", "Ravi", "Meera", "John", "Farah", "Luis"),
    "surname": ("Nair", "Das", "Miller", "Khan", "Rossi"),
    "bank": ("North Bank", "River Bank", "City Bank", "Harbour Bank"),
    "city": ("Pune", "Delhi", "Leeds", "Lyon", "Turin"),
    "sum": ("500", "2,000", "9,000", "25,000"),
    "fee": ("99", "250", "1,200"),
    "minutes": ("ten", "thirty", "sixty"),
    "hour": ("nine", "noon", "four", "six"),
    "day": ("Monday", "Tuesday", "Friday"),
    "item": ("sofa", "phone", "bicycle", "camera"),
    "app": ("AnyDesk", "TeamViewer", "QuickSupport"),
    "office": ("the customs office", "the police station", "the tax office"),
    "courier": ("Swift Parcel", "Blue Courier", "Day Post"),
    "doctor": ("Dr. Rao", "Dr. Weiss", "Dr. Lee"),
    "food": ("rice and dal", "two pizzas", "a fish curry"),
    "street": ("Lake Road", "Mill Lane", "Station Street"),
    "prize": ("a car", "a holiday", "25 lakh"),
    "percent": ("12", "20", "35"),
    "digits": ("4821", "0075", "9913"),
}


def _family(name: str, scam_type: str, label: int, *turns: str) -> Family:
    """Turns alternate, the caller first; phrasings of a turn are parted by a bar."""
    return Family(name, scam_type, label, tuple((RECEIVER if i % 2 else CALLER, tuple(t.split("|"))) for i, t in enumerate(turns)))


FAMILIES = (
    _family("code_request", "bank_fraud", 1, "Hello {name}, {bank} here about your card.|This is {surname} from {bank}, a payment of {sum} is pending.", "What do I have to do?|I made no payment.", "Please read me the code you just got.|Share your OTP and I stop it."),
    _family("papers_expired", "bank_fraud", 1, "Your KYC has expired, {name}.|The account at {bank} will be blocked today over KYC.", "Can I come to the branch?|Since when?", "There is no time, you have {minutes} minutes.|Send me your PIN and I renew it."),
    _family("arrest_by_phone", "govt_impersonation", 1, "I call from {office} in {city}.|This is officer {surname}.", "Is something wrong?|Yes?", "There is an arrest warrant in your name.|You are under digital arrest, stay on the call."),
    _family("parcel_seized", "govt_impersonation", 1, "A parcel in your name was held by {office}.|{courier} found papers of yours in a parcel.", "I sent nothing.|What parcel?", "Move {sum} to a safe account for verification.|Pay {fee} or an FIR is registered."),
    _family("remote_help", "tech_support", 1, "Your computer reports a virus, {name}.|I am from the help desk in {city}.", "Really?|Mine?", "Install {app} so that I can see it.|Open {app} and tell me the number {digits}."),
    _family("refund_by_code", "refund_scam", 1, "We owe you a refund of {sum}.|You paid twice, {sum} comes back.", "Good, how?|When?", "Scan this QR code to get it.|Accept the collect request and enter your PIN to receive it."),
    _family("prize_fee", "prize_scam", 1, "You won {prize} in the lucky draw!|Your number {digits} is the winner of {prize}.", "I never took part.|Is that so?", "Only the processing fee of {fee} is due.|Pay {fee} and we release the prize."),
    _family("quick_loan", "loan_scam", 1, "Your loan of {sum} is overdue.|Pay the app by {hour} today.", "I have paid it.|I need more time.", "Then we send edited photos to all contacts.|We have your contact list and your gallery."),
    _family("soldier_buyer", "marketplace_scam", 1, "I saw your {item} and I am posted with the army.|I buy the {item}, my unit in {city} pays.", "When will you come?|Good.", "I pay by QR, scan my code.|The army transfer needs your PIN."),
    _family("sure_profit", "investment_scam", 1, "We offer a guaranteed return of {percent}% a month.|Double your money by {day}.", "How safe is it?|Who are you?", "It is risk free profit, {name} earned {sum}.|Today only, start with {sum}."),
    _family("family_trouble", "unknown_scam", 1, "Your son is at {office} in {city}.|It is me, I lost my phone in {city}.", "What happened?|Who is this?", "Send {sum} and tell nobody.|Do not tell the family, I need {sum}."),
    _family("job_deposit", "unknown_scam", 1, "You got the job at {bank}.|The job pays {sum} a week.", "That is great.|What is it?", "A deposit of {fee} is needed by {hour}.|Pay {fee} for the training."),
    _family("power_cut", "unknown_scam", 1, "Your power is cut at {hour}.|The bill for {street} is open.", "I have paid it.|How much?", "Pay {fee} on the link within {minutes} minutes.|Call {digits} and pay {fee}, last warning."),
    _family("parcel_today", "delivery", 0, "{courier}, a parcel for {name}.|I have your {item} from {courier}.", "Which street?|Leave it at the door.", "I am at {street}.|I come at {hour}."),
    _family("food_order", "delivery", 0, "I bring {food}.|Your order is ready, {food}.", "Thank you.|How long?", "About {minutes} minutes.|I am on {street}."),
    _family("policy_renewal", "insurance", 0, "Your policy ends on {day}.|The yearly premium is {sum}.", "Can I pay at the branch?|Send me a letter.", "Of course, in {city}.|It is in the mail."),
    _family("phone_offer", "telemarketing", 0, "We have a new plan for {fee} a month.|{name} from the phone company, do you have a minute?", "Not interested.|Send me the details.", "Have a good day.|I send them by {day}."),
    _family("wrong_call", "wrong_number", 0, "Is this {name} {surname}?|Is that the bakery on {street}?", "No, wrong number.|Sorry, no.", "My mistake.|Pardon me."),
    _family("doctor_visit", "appointment", 0, "{doctor} sees you on {day}.|I call from the practice of {doctor}.", "At what time?|Fine.", "At {hour}.|Please bring your card."),
    _family("haircut", "appointment", 0, "Can we move your cut to {day}?|Your stylist {name} is ill on {day}.", "Sure.|What about {hour}?", "See you then.|That works."),
    _family("lunch", "none", 0, "Shall we have lunch at {hour}?|Are you in {city} on {day}?", "Yes, gladly.|Maybe.", "I book {food}.|See you on {street}."),
    _family("school", "none", 0, "The school meets on {day}.|{name} was late on {day}.", "I will come.|Thank you for the call.", "It begins at {hour}.|No harm done."),
    _family("bank_notice", "none", 0, "{bank} never asks for codes by phone.|Your new card from {bank} is ready.", "Good to know.|Where?", "Come to the branch on {street}.|It is in {city}."),
    _family("repair", "none", 0, "Your {item} is repaired.|The {item} needs a part for {fee}.", "When can I fetch it?|Please go on.", "From {hour} on.|On {day}."),
    _family("old_friend", "none", 0, "It is {name}, long time no see!|Guess who is in {city}.", "How are you?|What a surprise.", "Let us meet on {day}.|I still have your {item}."),
)
